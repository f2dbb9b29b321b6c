"""Operations on tables of page blocks: relabelling, counts, HTML of tables, joined tables, notes, acceptance rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import col
from paperloom.operators.layout import PAGE, descendants

#: Leaders, empty and unclosed LaTeX commands in table cells, in the order in which they are cleaned.
CELL_RULES = [
    (r"(\s?[.\-_…]){2,}", ""),
    (r"[.\-_…]{2,}", ""),
    (r"\\mathbf\{([0-9.,$€£]+)\}", "<b>$1</b>"),
    (r"\\[a-zA-Z]+\{\s*\}", ""),
    (r"\\phantom\{.*?\}", ""),
    (r"\\quad", ""),
    (r"\\,", ""),
    (r"\\mathsf\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z]+\{([^}]*)$", "$1"),
    (r"^\s*\\text\{([^}]*)\}\s*$", "$1"),
]


def relabelled(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocks whose label a rule ``old, new, most`` changes when its confidence is not above ``most``. Rules are few."""
    rows = blocks.join(F.broadcast(rules), F.col("kind") == F.col("old"), "left")
    use = F.col("new").isNotNull() & (F.col("confidence") <= F.col("most"))
    return rows.withColumn("kind", F.when(use, F.col("new")).otherwise(F.col("kind"))).drop("old", "new", "most")


def kind_counts(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, kind, n, place``: kinds of a page, the most common first."""
    counts = blocks.groupBy(*PAGE, "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "kind")))


def clean_cell(text: Column | str) -> Column:
    """A cell's line without leaders and stray LaTeX; null for a lone full stop or nothing."""
    out = F.trim(col(text))
    kept = (out != "") & (out != ".")
    for pattern, to in CELL_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.when(kept, out)


def html_tables(cells: DataFrame) -> DataFrame:
    """``table_id, html``: rows and cells in order, spans over 1 as attributes."""
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    span = lambda c: F.when(F.col(c) > 1, F.format_string(f' {c}="%d"', F.col(c))).otherwise("")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))
    in_order = lambda key, item: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, item.alias("x")))), lambda s: s["x"]), "")
    rows = cells.groupBy("table_id", "row_id").agg(F.concat(F.lit("<tr>"), in_order("col_id", cell), F.lit("</tr>")).alias("row"))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table><tbody>"), in_order("row_id", F.col("row")), F.lit("</tbody></table>")).alias("html"))


def merged_tags(html: Column | str, tag: str) -> Column:
    """Neighbouring elements of one kind as one; white space between them becomes one space.

    A closing tag directly followed by an opening one goes as a pair, so one pass reaches the end of every chain.
    """
    out = F.regexp_replace(col(html), rf"</{tag}><{tag}>", "")
    return F.regexp_replace(out, rf"</{tag}>\s+<{tag}>", " ")


def line_height(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, page, block_no, height``: a block's height over its number of lines, 0 without lines."""
    n = lines.groupBy(*PAGE, "block_no").agg(F.count("*").alias("n"))
    return blocks.join(n, [*PAGE, "block_no"], "left").select(*PAGE, "block_no", F.coalesce((F.col("y1") - F.col("y0")) / F.col("n"), F.lit(0.0)).alias("height"))


def joined_tables(cells: DataFrame, island: str = "island") -> DataFrame:
    """Tables of an island under one id, each below the one before: rows move down by the rows that stand above."""
    heights = cells.groupBy(island, "table_id").agg(F.max("row_id").alias("last"))
    w = Window.partitionBy(island).orderBy("table_id")
    shift = F.coalesce(F.sum(F.col("last") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heights = heights.withColumn("shift", shift).withColumn("first_id", F.first("table_id").over(w)).drop("last")
    return cells.join(heights, [island, "table_id"]).select(F.col("first_id").alias("table_id"), (F.col("row_id") + F.col("shift")).alias("row_id"), "col_id", "text")


def notes(pages: DataFrame) -> DataFrame:
    """``doc_id, notes``: a document's page notes in order under their numbers."""
    one = F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"), F.lit("\n"), F.coalesce("note", F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", one.alias("x")))), lambda s: s["x"]), "\n\n").alias("notes"))


def widened_selection(blocks: DataFrame, kind: str, candidates: tuple[str, ...], share: float = 0.3) -> DataFrame:
    """Blocks of a kind, and on pages where they are at least ``share`` of the candidates all of these."""
    w = Window.partitionBy(*PAGE)
    of_kind, of_any = F.col("kind") == kind, F.col("kind").isin(kind, *candidates)
    part = F.count_if(of_kind).over(w) / F.count_if(of_any).over(w)
    return blocks.withColumn("_p", part).filter(of_kind | (of_any & (F.col("_p") >= share))).drop("_p")


def accepted_rewrite(old: Column | str, new: Column | str, least: float = 0.6, refusal: str = "no corrections") -> Column:
    """The rewritten text where it is usable: no refusal, and not much shorter than the old one."""
    old, new = col(old), F.trim(F.coalesce(col(new), F.lit("")))
    usable = ~F.contains(F.lower(new), F.lit(refusal)) & (F.length(new) >= F.length(old) * least) & (new != "")
    return F.when(usable, new).otherwise(old)


def reordered(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """Blocks with ``place``: a proposed order ``doc_id, page, block_nos`` holds only if it names exactly the page's blocks."""
    own = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list("block_no")).alias("have"))
    good = orders.join(own, PAGE).filter(F.array_sort("block_nos") == F.col("have")).select(*PAGE, "block_nos")
    rows = blocks.join(good, PAGE, "left")
    plain = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_no"))
    return rows.withColumn("place", F.coalesce(F.array_position("block_nos", F.col("block_no")), plain.cast("long")) - 1).drop("block_nos")


def superscripts(spans: DataFrame) -> DataFrame:
    """Spans with ``superscript``: the first of a footnote, if it begins with digits or marks."""
    w = Window.partitionBy(*PAGE, "block_no").orderBy("span_no")
    return spans.withColumn("superscript", (F.row_number().over(w) == 1) & F.col("text").rlike(r"^[0-9\W]+"))


def joined_beside(left: DataFrame, right: DataFrame, most: int = 5) -> DataFrame:
    """``table_id, row_id, col_id, text``: pairs of tables under one id, the second to the right of the first.

    They are joined where their numbers of rows differ by less than ``most``; else both stay as they are, the second
    under its own id ``right_id``. ``right(table_id, right_id, row_id, col_id, text)``; spans count in the numbers.
    """
    size = lambda cells: cells.groupBy("table_id").agg(F.max(F.col("row_id") + F.col("rowspan")).alias("rows"), F.max(F.col("col_id") + F.col("colspan")).alias("cols"))
    both = size(left).join(size(right).select("table_id", F.col("rows").alias("r_rows")), "table_id")
    fits = both.select("table_id", F.col("cols").alias("shift"), (F.abs(F.col("rows") - F.col("r_rows")) < most).alias("fits"))
    moved = right.join(fits, "table_id", "left").select(F.when(F.col("fits"), F.col("table_id")).otherwise(F.col("right_id")).alias("table_id"), "row_id", (F.col("col_id") + F.when(F.col("fits"), F.col("shift")).otherwise(0)).alias("col_id"), "text")
    return left.select("table_id", "row_id", "col_id", "text").unionByName(moved)


def same_columns(first: DataFrame, second: DataFrame, most: int = 2) -> DataFrame:
    """``table_id, fits``: tables that may be joined below each other, as their numbers of columns differ by less than ``most``."""
    count = lambda cells, name: cells.groupBy("table_id").agg(F.max(F.col("col_id") + F.col("colspan")).alias(name))
    return count(first, "a").join(count(second, "b"), "table_id").select("table_id", (F.abs(F.col("a") - F.col("b")) < most).alias("fits"))


class _Cells(HTMLParser):
    """The cells of the first table as ``row, spans, header, text``; nested markup counts with its text only."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list]] = []
        self.open, self.done, self.cell = False, False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and not self.done:
            self.open = True
        elif tag == "tr" and self.open:
            self.rows.append([])
        elif tag in ("td", "th") and self.open and self.rows:
            spans = [next((int(v) for k, v in attrs if k == name and (v or "").isdigit()), 1) for name in ("rowspan", "colspan")]
            self.cell = [*spans, tag == "th", ""]
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[3] += "\n"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "table" and self.open:
            self.open, self.done, self.cell = False, True, None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[3] += data


#: A table as ``html_tables`` writes it, without spans over several rows and without characters that HTML escapes; its cells.
_FLAT = re.compile(r'<table><tbody>(?:<tr>(?:<t([dh])(?: colspan="[0-9]{1,4}")?>[^<&]*</t\1>)*</tr>)*</tbody></table>')
_FLAT_CELL = re.compile(r'<t([dh])(?: colspan="([0-9]+)")?>([^<&]*)<')


def flat_cells(page: str) -> list[tuple[int, int, int, int, bool, str]] | None:
    """As ``placed_cells`` for a flat table, whose cells stand one behind the other; None for any other text."""
    if _FLAT.fullmatch(page) is None:
        return None
    out = []
    for r, row in enumerate(page[14:-16].split("</tr>")[:-1]):
        c = 0
        for tag, span, text in _FLAT_CELL.findall(row):
            across = int(span) if span else 1
            if across:
                out.append((r, c, 1, across, tag == "h", text.strip()))
                c += across
    return out


def placed_cells(page: str) -> list[tuple[int, int, int, int, bool, str]]:
    """``row, column, row span, column span, header, text``: each cell takes the first place of its row that no span from
    above covers; spans end at the table's edges, and cells beyond its width or without extent fall away."""
    flat = flat_cells(page)
    if flat is not None:
        return flat
    reader = _Cells()
    reader.feed(page)
    reader.close()
    width = max((sum(cell[1] for cell in row) for row in reader.rows), default=0)
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(reader.rows):
        c = 0
        for down, across, header, text in row:
            while (r, c) in taken:
                c += 1
            if c >= width:
                break
            down, across = min(down, len(reader.rows) - r), min(across, width - c)
            if down and across:
                taken |= {(y, x) for y in range(r, r + down) for x in range(c, c + across)}
                out.append((r, c, down, across, header, text.strip()))
                c += across
    return out


def html_cells(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """``key, row_id, col_id, rowspan, colspan, is_header, text`` of the first table of each HTML text; without one, no rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = [placed_cells(page or "") for page in part.column(1).to_pylist()]
            at = [k for k, own in enumerate(cells) for _ in own]
            columns = list(zip(*(c for own in cells for c in own), strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, "row_id", "col_id", "rowspan", "colspan", "is_header", "text"])

    return tables.select(key, html).mapInArrow(run, f"{key} {tables.schema[key].dataType.simpleString()}, row_id int, col_id int, rowspan int, colspan int, is_header boolean, text string")


def escaped(text: Column | str) -> Column:
    return F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def block_html(kind: Column | str = "kind", text: Column | str = "text", level: Column | str = "level", goes_on: Column | str = "goes_on", ignored: Column | str = "ignored", alt: Column | str = "alt") -> Column:
    """A block as HTML by its kind: headings by level 1 to 6, list items by nesting, code, captions, footnotes, images with
    their alternative text, rules for page breaks; text that goes on from a block before says so. Ignored blocks are ''."""
    kind, body, level, goes_on, ignored, alt = col(kind), escaped(F.coalesce(col(text), F.lit(""))), col(level), col(goes_on), col(ignored), col(alt)
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(2)))).cast("string")
    attr = F.when(F.coalesce(goes_on, F.lit(False)), F.lit(" class='has-continuation'")).otherwise("")
    wrapped = lambda tag, a=F.lit(""): F.concat(F.lit(f"<{tag}"), a, F.lit(">"), body, F.lit(f"</{tag}>"))
    deep = F.coalesce(level, F.lit(0))
    item = F.concat(F.repeat(F.lit("<ul>"), deep), wrapped("li"), F.repeat(F.lit("</ul>"), deep))
    image = F.concat(F.lit('<p role="img"><img alt="'), F.replace(escaped(F.coalesce(alt, F.lit(""))), F.lit('"'), F.lit("&quot;")), F.lit('"></p>'))
    out = F.when(kind == "heading", F.concat(F.lit("<h"), n, F.lit(">"), body, F.lit("</h"), n, F.lit(">"))).when(kind == "list", item).when(kind == "code", F.concat(F.lit("<pre>"), body, F.lit("</pre>")))
    out = out.when(kind == "caption", wrapped("figcaption")).when(kind == "footnote", wrapped("small")).when(kind == "image", image).when(kind == "equation", F.concat(F.lit('<p><math display="block">'), body, F.lit("</math></p>"))).when(kind == "break", F.lit("<hr>"))
    return F.when(F.coalesce(ignored, F.lit(False)), "").otherwise(out.otherwise(wrapped("p", attr)))


def merged_places(cells: DataFrame) -> DataFrame:
    """``table_id, row_id, col_id, owner_row, owner_col``: the places that each cell with spans covers, its own included."""
    spans = cells.filter((F.col("rowspan") > 1) | (F.col("colspan") > 1)).select("table_id", F.col("row_id").alias("owner_row"), F.col("col_id").alias("owner_col"), "rowspan", "colspan")
    rows = spans.withColumn("row_id", F.explode(F.sequence(F.col("owner_row"), F.col("owner_row") + F.col("rowspan") - 1)))
    return rows.withColumn("col_id", F.explode(F.sequence(F.col("owner_col"), F.col("owner_col") + F.col("colspan") - 1))).select("table_id", "row_id", "col_id", "owner_row", "owner_col")


def embedded_images(tree: DataFrame, images: DataFrame) -> DataFrame:
    """``doc_id, block_id, images``: a map from block to image for each block and all that is below it.

    ``tree`` as in ``descendants``, ``images(doc_id, block_id, image)``. A block's own image counts too.
    """
    below = descendants(tree, ("image", "figure")).select("doc_id", F.col("ancestor").alias("holder"), "block_id")
    own = tree.filter("NOT removed").filter(F.col("kind").isin("image", "figure")).select("doc_id", F.col("block_id").alias("holder"), "block_id")
    held = below.unionByName(own).join(images, ["doc_id", "block_id"])
    entries = F.array_sort(F.collect_set(F.struct(F.col("block_id").alias("key"), F.col("image").alias("value"))))
    return held.groupBy("doc_id", F.col("holder").alias("block_id")).agg(F.map_from_entries(entries).alias("images"))
