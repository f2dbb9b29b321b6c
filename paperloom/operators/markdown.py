"""Cleaning of Markdown: bullets, heading levels, titles, labels, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import col, squeeze_blank_lines, utrim
from paperloom.operators.chunking import LEVELS

#: Fixed value: the glyphs that stand for a bullet.
BULLETS = "■□●○◎◯◆◇▪▫♦◊•‣⁃‧·∙・◦►▶▷▸▹❖✦◾◽∎"
#: Signs that make no text of their own beside bullets.
SIGNS = BULLETS + "*+-.,、"
FENCE, PIPE, ANY_HEADING = r"^\s*```", r"^\s*\|", r"^(#{1,6})\s+(.*)$"
TITLE_LINE = r"(?m)^## (?:\*\*)?([^\n*]{2,80}?)(?:\*\*)?[ \t]*(?:\n|\z)"


def without_bullet(line: Column | str) -> Column:
    """A line without its bullet, for lines that begin with a bullet glyph, behind a list marker or bold marks or not.

    What goes are the glyphs, a full stop or comma behind them, the list marker and, where the line is bold, the marks on
    both sides; the indentation stays. Lines without a glyph stay as they are. Null for a line that is not blank and has
    nothing but glyphs and signs.
    """
    line, blanks = col(line), F.lit(" \t")
    left = lambda c: F.ltrim(c, blanks)
    starts = lambda c, chars: (c != "") & F.contains(F.lit(chars), F.substring(c, 1, 1))
    after = lambda c, n: F.substring(c, n, 1 << 30)
    body = left(line)
    listed = starts(body, "-*+") & F.substring(body, 2, 1).isin(" ", "\t")
    inner = F.when(listed, left(after(body, 2))).otherwise(body)
    bold = F.startswith(inner, F.lit("**"))
    inner = F.when(bold, left(after(inner, 3))).otherwise(inner)
    rest = left(F.ltrim(inner, F.lit(BULLETS)))
    rest = F.when(starts(rest, ".、,"), left(after(rest, 2))).otherwise(rest)
    end = F.rtrim(rest, blanks)
    unmarked = F.rtrim(F.substring(end, F.lit(1), F.length(end) - 2), blanks)
    rest = F.when(bold & F.endswith(end, F.lit("**")), unmarked).otherwise(rest)
    indent = F.substring(line, F.lit(1), F.length(line) - F.length(body))
    marks_only = (utrim(line) != "") & (utrim(F.translate(line, SIGNS, "")) == "")
    return F.when(~marks_only, F.when(starts(inner, BULLETS), F.concat(indent, rest)).otherwise(line))


def plain_bullets(text: Column | str) -> Column:
    kept = F.filter(F.transform(F.split(col(text), "\n", -1), without_bullet), lambda x: x.isNotNull())
    return squeeze_blank_lines(F.array_join(kept, "\n"))


def flat_headings(lines: DataFrame) -> DataFrame:
    """Lines with headings brought to two levels: one or two marks become three, more become four. Code fences and
    table rows stay; a line is inside a fence when an odd number of fences came before it."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("text").rlike(FENCE)
    inside = F.coalesce(F.sum(fence.cast("int")).over(w), F.lit(0)) % 2 == 1
    marks = F.length(F.regexp_extract("text", ANY_HEADING, 1))
    flat = F.concat(F.when(marks <= 2, "### ").otherwise("#### "), F.regexp_extract("text", ANY_HEADING, 2))
    return lines.withColumn("text", F.when((marks > 0) & ~inside & ~fence & ~F.col("text").rlike(PIPE), flat).otherwise(F.col("text")))


def filled_titles(pages: DataFrame) -> DataFrame:
    """Pages with ``title`` from the first second-level heading where they have none; that line leaves the body, once."""
    found = utrim(F.regexp_extract("body", TITLE_LINE, 1))
    use = (F.coalesce("title", F.lit("")) == "") & (found != "")
    return pages.select("*", F.when(use, found).otherwise(F.col("title")).alias("_t"), F.when(use, F.array_join(F.split("body", TITLE_LINE, 2), "")).otherwise(F.col("body")).alias("_b")).withColumns({"title": F.col("_t"), "body": F.col("_b")}).drop("_t", "_b")


def without_texts(text: Column | str, banned: Column) -> Column:
    """The text without each banned one, the longest first."""
    order = F.array_sort(F.transform(banned, lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b"))))
    return F.aggregate(order, col(text), lambda t, x: F.replace(t, x["b"], F.lit("")))


def noted_placeholders(text: Column | str, mark: str, note: str) -> Column:
    return F.replace(col(text), F.lit(mark), F.lit(note))


def image_label(body: Column | str = "body") -> Column:
    """The deepest heading of a section; without one its single line of text; else ``image``."""
    deepest = F.coalesce(*(F.col(f"h{n}") for n in reversed(LEVELS)))
    lines = F.filter(F.transform(F.split(col(body), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), utrim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.coalesce(deepest, F.when(F.size(lines) == 1, F.get(lines, F.lit(0))), F.lit("image"))


def first_heading(text: Column | str, fallback: Column) -> Column:
    found = utrim(F.regexp_extract(col(text), r"(?m)^#(?!#)[ \t]*(.+?)[ \t]*$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


def page_groups(docs: DataFrame, text: str, size: int = 3) -> DataFrame:
    """``doc_id, part, text``: paginated output cut at its separators, the preamble dropped, ``size`` pages together."""
    pages = docs.select("doc_id", F.posexplode(F.split(text, r"\{\d+\}-{48}\n*", -1)).alias("page", "body")).filter("page > 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"])
    return pages.groupBy("doc_id", F.floor((F.col("page") - 1) / size).cast("int").alias("part")).agg(F.array_join(ordered, "\n\n").alias("text"))


def image_edits(log: DataFrame) -> DataFrame:
    """``path, trashed``: after deletions and undos in order, the last action of a path counts."""
    last = log.groupBy("path").agg(F.max_by("action", "entry_id").alias("action"))
    return last.select("path", (F.col("action") == "delete").alias("trashed"))
