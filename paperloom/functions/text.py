"""Column functions over text, paths, numbers and ids. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS name space of RFC 4122 as hexadecimal digits.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
#: The code points that count as a space in extracted text.
SPACES = "\u2003\u2002\u00a0\u200b\u3000"
_NUMBER = r"[-+]?\d+(?:\.\d+)?"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def no_space(c: Column | str) -> Column:
    """Without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", "")


def norm(c: Column | str) -> Column:
    """The form in which names are compared: no white space, lower case."""
    return F.lower(no_space(c))


def grams(c: Column | str, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text; none where it is shorter."""
    text = col(c)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def filled(c: Column | str) -> Column:
    """Null for an empty string, as missing values count."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*(filled(c) for c in columns))


def to_number(c: Column | str) -> Column:
    """A number when the text is little more than one: at most 4 characters beside it, thousands commas dropped."""
    text = F.replace(F.trim(F.coalesce(col(c), F.lit(""))), F.lit(","), F.lit(""))
    plain = F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))
    found = F.regexp_extract(text, _NUMBER, 0)
    rest = F.length(text) - F.length(found)
    return F.coalesce(plain, F.when((found != "") & (rest <= 4), found.try_cast("double")))


def path_parts(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"[\\/]+"), lambda x: x != "")


def project_of(key: Column | str, unknown: str = "unclassified") -> Column:
    """Second folder of a key with three parts or more, first of one with two."""
    parts = path_parts(key)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.lit(unknown))


def top_folder(key: Column | str) -> Column:
    parts = path_parts(key)
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)))


def doc_type_of(key: Column | str, own: Column | None = None, names: dict[str, str] | None = None, default: str = "unclassified") -> Column:
    """A document's type: its own, else its folder's name in ``names``, else the folder, else the default."""
    folder = top_folder(key)
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), folder) if names else F.lit(None).cast("string")
    return first_filled(own if own is not None else F.lit(None).cast("string"), mapped, folder, F.lit(default))


def file_name(path: Column | str) -> Column:
    return F.element_at(path_parts(path), -1)


def stem_of(path: Column | str) -> Column:
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def extension_of(path: Column | str) -> Column:
    """The last dot and what follows, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]*)$", 1))


def tag_of(path: Column | str, tags: dict[str, str], default: str = "other") -> Column:
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    return F.coalesce(F.element_at(table, extension_of(path)), F.lit(default))


def human_size(n: Column | str, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB", "PB")) -> Column:
    n, out = col(n).cast("double"), None
    for k, unit in enumerate(units):
        text = F.format_string("%.2f " + unit, F.bround(n / (1024.0**k), 2))
        if k == len(units) - 1:
            return out.otherwise(text) if out is not None else text
        test = n < 1024.0 ** (k + 1)
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def human_time(seconds: Column | str) -> Column:
    """Days, hours, minutes and seconds, parts of zero left out."""
    s = col(seconds).cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(F.pmod(s, F.lit(86400)) / 3600), "h"), (F.floor(F.pmod(s, F.lit(3600)) / 60), "m"), (F.pmod(s, F.lit(60)), "s")]
    return F.concat_ws(" ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts))


def uuid5(name: Column | str, namespace: str = NAMESPACE_DNS) -> Column:
    """The version-5 UUID of a name: SHA-1 of name space and name with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(name), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def quoted(literal: str) -> str:
    """A regular expression that matches the literal."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_trimmed(c: Column | str, delimiter: str | None) -> Column:
    """Pieces between literal delimiters, trimmed, without empty ones; without a delimiter the whole text."""
    pieces = F.split(col(c), quoted(delimiter), -1) if delimiter else F.array(col(c))
    return F.filter(F.transform(pieces, utrim), lambda x: x != "")


def squeeze_blank_lines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\n{3,}", "\n\n")


def one_space(c: Column | str) -> Column:
    return F.translate(col(c), SPACES, " " * len(SPACES))


#: An image reference ends its line, and its path may hold parentheses; what stands alone goes with its line.
IMAGE_REF = r"!\[[^\]\n]*\]\((.+)\)[ \t]*$"
IMAGE_LINE = r"^[ \t]*!\[[^\]\n]*\]\(.+\)[ \t]*\n?"
#: Only a line feed ends a line.
LINES = "(?md)"


def strip_image_refs(c: Column | str) -> Column:
    """Markdown without image references, those on lines of their own with the line."""
    return squeeze_blank_lines(F.regexp_replace(F.regexp_replace(col(c), LINES + IMAGE_LINE, ""), LINES + IMAGE_REF, ""))


def image_paths(c: Column | str) -> Column:
    """The paths of image references; a reference goes to the last closing parenthesis of its line."""
    return F.regexp_extract_all(col(c), F.lit(LINES + IMAGE_REF), F.lit(1))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?s)<[^>]*>", "")


def without_numbers_at_ends(c: Column | str) -> Column:
    """A header's or footer's text without line breaks and without the numbers that change from page to page."""
    text = utrim(F.replace(col(c), F.lit("\n"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, r"^\d+\s*", ""), r"\s*\d+$", "")


def first_json_object(c: Column | str) -> Column:
    """From the first brace to the last, after thinking blocks are dropped; null without one."""
    text = F.regexp_replace(col(c), r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def attribute_question(attribute: Column | str) -> Column:
    """An attribute's name as a query, without its unit."""
    return F.trim(F.substring_index(col(attribute), "_", 1))


def clean_title(c: Column | str, most: int = 20) -> Column:
    """First line, without a leading label and quotes, cut to ``most`` characters with an ellipsis."""
    line = F.trim(F.substring_index(F.trim(col(c)), "\n", 1))
    line = F.regexp_replace(line, r"^(?i:title)\s*[:：]\s*", "")
    line = F.regexp_replace(line, "^[\"'“”「『]+|[\"'“”」』]+$", "")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


#: White space in the Unicode sense, as the inside of a character class.
WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def quality_issue(c: Column | str) -> Column:
    """True where extracted text looks broken: no text, mostly runs of white space, mostly runs of line breaks, too few
    letters and digits beside blanks and line breaks, or many replacement characters.

    A run counts once, however long: it is held against the runs and the other characters together.
    """
    text = F.coalesce(col(c), F.lit(""))
    n = F.length(text)
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    runs = lambda pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda part, whole: F.when(whole > 0, part / whole)
    spaces, breaks = runs(f"[{WHITE}]+"), runs(r"\n+")
    dense = left(r"[ \n]")
    alnum = F.coalesce(share(n - left(r"[\p{L}\p{N}]"), dense), F.lit(1.0))
    invalid = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    bad = (share(spaces, spaces + left(f"[{WHITE}]+")) > 0.7) | (share(breaks, breaks + left(r"\n+")) > 0.6) | (alnum < 0.3) | (invalid > F.greatest(F.lit(6.0), n * 0.03))
    return (n == 0) | F.coalesce(bad, F.lit(False))


def delimiter_meant(typed: str) -> str:
    """A delimiter as it is typed into a form: ``\n``, ``\t`` and other escapes stand for their characters.

    It is a parameter of a plan, so this runs on the driver. What is no escape stays as it is typed.
    """
    names = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
    out, k = [], 0
    while k < len(typed):
        if typed[k] == "\\" and k + 1 < len(typed) and typed[k + 1] in names:
            out.append(names[typed[k + 1]])
            k += 2
        else:
            out.append(typed[k])
            k += 1
    return "".join(out)


def safe_name(c: Column | str) -> Column:
    """A file name of letters, digits, spaces and underscores."""
    return utrim(F.regexp_replace(col(c), r"[^\p{L}\p{N} _]", ""))


def image_places(c: Column | str) -> Column:
    """``array<struct<path, at, size>>``: image references with the place of the reference, from 0, and its length.

    Places are found by the text between references, so they count code points. A reference includes the blanks behind it.
    """
    whole = f"({IMAGE_REF})"
    refs, paths, gaps = F.regexp_extract_all(col(c), F.lit(LINES + whole), F.lit(1)), image_paths(c), F.split(col(c), LINES + IMAGE_REF, -1)
    before = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(refs, F.lit(1), i), F.lit(0), lambda n, r: n + F.length(r))
    return F.transform(refs, lambda r, i: F.struct(F.get(paths, i).alias("path"), before(i).alias("at"), F.length(r).alias("size")))


def without_line_at(c: Column | str, at: Column | int) -> Column:
    """The text without the line, with its line break, that holds the place ``at`` (from 0)."""
    text, at = col(c), at if isinstance(at, Column) else F.lit(at)
    head, tail = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    above = F.split(head, "\n", -1)
    kept = F.when(F.size(above) > 1, F.concat(F.array_join(F.slice(above, F.lit(1), F.size(above) - 1), "\n"), F.lit("\n"))).otherwise("")
    rest = F.when(F.contains(tail, F.lit("\n")), F.substring(tail, F.instr(tail, "\n") + 1, F.length(tail))).otherwise("")
    return F.concat(kept, rest)


def inserted_at(c: Column | str, new: Column, at: Column | int) -> Column:
    """The text with ``new`` at a place, at its end where the place is beyond that."""
    text, at = col(c), at if isinstance(at, Column) else F.lit(at)
    return F.concat(F.substring(text, F.lit(1), at), new, F.substring(text, at + 1, F.length(text)))


def page_body(c: Column | str) -> Column:
    """A page without its anchor line and the rule at its end, trimmed."""
    text = F.regexp_replace(col(c), r"^## 第 \d+ 頁[ \t]*\n?", "")
    return utrim(F.regexp_replace(text, r"\n-{3,}\s*\n?$", ""))


def edited_page(page: Column | str, number: Column | str, edited: Column | str) -> Column:
    """The page after an edit of its body: anchor and closing rule come back around the new body; a body that differs in
    nothing but white space at its ends leaves the page as it is."""
    page, new = col(page), utrim(edited)
    ruled = F.when(page.rlike(r"\n-{3,}\s*\n?$"), "\n---\n").otherwise("")
    return F.when(new.isNull() | (new == page_body(page)), page).otherwise(F.concat(F.lit("## 第 "), col(number).cast("string"), F.lit(" 頁\n"), new, F.lit("\n"), ruled))


def font_formats(flags: Column | str, name: Column | str, weight: Column | str | None = None) -> Column:
    """The formats of a font as a sorted array: from the bits of a PDF font descriptor (fixed width 1, italic 7, forced
    bold 19, counted from 1), from its name and from a weight over 500; ``plain`` without any."""
    flags, name = F.coalesce(col(flags), F.lit(0)), F.lower(F.coalesce(col(name), F.lit("")))
    bit = lambda n: F.shiftright(flags, n - 1).bitwiseAND(F.lit(1)) == 1
    heavy = F.coalesce(col(weight) > 500, F.lit(False)) if weight is not None else F.lit(False)
    found = F.array(F.when(bit(19) | F.contains(name, F.lit("bold")) | heavy, "bold"), F.when(bit(7) | F.contains(name, F.lit("ital")) | F.contains(name, F.lit("oblique")), "italic"), F.when(bit(1) | F.contains(name, F.lit("mono")) | F.contains(name, F.lit("courier")), "code"))
    kept = F.array_sort(F.filter(found, lambda x: x.isNotNull()))
    return F.when(F.size(kept) == 0, F.array(F.lit("plain"))).otherwise(kept)


def unwrapped(html: Column | str, tag: str) -> Column:
    """The inside of an element that is all of the text; other texts stay as they are."""
    return F.regexp_replace(col(html), rf"(?s)^\s*<{tag}(?:\s[^>]*)?>(.*)</{tag}>\s*$", "$1")


def merged_math(html: Column | str) -> Column:
    """Inline formulas that stand side by side as one; display formulas stay apart."""
    return F.regexp_replace(col(html), r"(?<=[^>])</math>(\s*)<math>", "$1")


def utc_text(c: Column | str) -> Column:
    """A time stamp as ISO 8601 text to the second in UTC, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(c).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
