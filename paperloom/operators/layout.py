"""Page layout: lines to blocks, reading order, groups, tables. Spatial joins have document, page and a tile of the page as equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.geometry import Box, reading_row
from paperloom.operators.tiles import meeting_pairs, nearest

PAGE = ["doc_id", "page"]


def side(rows: DataFrame, prefix: str, item: str) -> DataFrame:
    """Boxes under other names, for joins of a table with itself or another."""
    return rows.select(*PAGE, F.col(item).alias(f"{prefix}id"), *(F.col(c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def largest_overlap(lines: DataFrame, blocks: DataFrame, line: str = "line_no", block: str = "block_no") -> DataFrame:
    """``doc_id, page, line, block, area``: each line's block with the largest overlap, of equal ones the first."""
    pairs = meeting_pairs(side(lines, "a_", line), side(blocks, "b_", block))
    area = Box.of("a_").intersection(Box.of("b_"))
    return pairs.groupBy(*PAGE, F.col("a_id").alias(line)).agg(F.max_by("b_id", F.struct(area, -F.col("b_id"))).alias(block), F.max(area).alias("area"))


def nearest_block(lines: DataFrame, blocks: DataFrame, most: float = 20.0, x_weight: float = 5.0, line: str = "line_no", block: str = "block_no") -> DataFrame:
    """``doc_id, page, line, block``: for lines that overlap no block, the nearest by centre, null beyond ``most``."""
    own = largest_overlap(lines, blocks, line, block).select(*PAGE, line)
    alone = lines.join(own, [*PAGE, line], "left_anti")
    best = nearest(side(alone, "a_", line), side(blocks, "b_", block), lambda a, b: a.center_distance(b, x_weight=x_weight), lambda w, h: F.least(w * x_weight**0.5, h))
    return best.select(*PAGE, F.col("a_id").alias(line), F.when(F.col("far") < most, F.col("b_id")).alias(block))


def assigned(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every line's block: by overlap, else the nearest, else null for a block of its own."""
    return largest_overlap(lines, blocks).select(*PAGE, "line_no", "block_no").unionByName(nearest_block(lines, blocks))


def coverage(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, page, share``: the part of a page's blocks that at least one line meets."""
    hit = meeting_pairs(side(blocks, "a_", "block_no"), side(lines, "b_", "line_no")).select(*PAGE, F.col("a_id").alias("block_no")).distinct()
    rows = blocks.select(*PAGE, "block_no").join(hit.withColumn("hit", F.lit(1)), [*PAGE, "block_no"], "left")
    return rows.groupBy(*PAGE).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def crowded_pages(lines: DataFrame, most: int = 2) -> DataFrame:
    """Pages where a line meets more than ``most`` lines, itself included."""
    pairs = meeting_pairs(side(lines, "a_", "line_no"), side(lines, "b_", "line_no"))
    return pairs.groupBy(*PAGE, "a_id").count().filter(F.col("count") > most).select(*PAGE).distinct()


def largest_mutual_share(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, share``: the largest part of a block that another covers."""
    pairs = meeting_pairs(side(blocks, "a_", "block_no"), side(blocks, "b_", "block_no")).filter("a_id <> b_id")
    most = pairs.groupBy(*PAGE).agg(F.max(Box.of("a_").share_inside(Box.of("b_"))).alias("share"))
    several = blocks.groupBy(*PAGE).agg(F.countDistinct("block_no").alias("n")).filter("n > 1").drop("n")
    return several.join(most, PAGE, "left").select(*PAGE, F.coalesce("share", F.lit(0.0)).alias("share"))


def not_covered(blocks: DataFrame, tables: DataFrame, share: float = 0.95) -> DataFrame:
    """Blocks that no table covers by more than ``share``."""
    hidden = meeting_pairs(side(blocks, "a_", "block_no"), side(tables, "b_", "block_no")).filter((F.col("a_id") != F.col("b_id")) & (Box.of("a_").share_inside(Box.of("b_")) > share))
    return blocks.join(hidden.select(*PAGE, F.col("a_id").alias("block_no")).distinct(), [*PAGE, "block_no"], "left_anti")


def nearest_corner(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, page, ref_no, block_no``: for each reference the block with the nearest upper left corner."""
    best = nearest(side(points, "a_", "ref_no"), side(blocks, "b_", "block_no"), lambda a, b: a.corner_distance(b), F.least, lambda box: (box.x0, box.y0))
    return best.filter("b_id IS NOT NULL").select(*PAGE, F.col("a_id").alias("ref_no"), F.col("b_id").alias("block_no"))


def merged_boxes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def widened(blocks: DataFrame, share: float = 0.05) -> DataFrame:
    """Blocks grown on all sides by ``share`` of their size or by half of the gap to the nearest block, whichever is less."""
    pairs = side(blocks, "a_", "block_no").join(side(blocks, "b_", "block_no"), PAGE).filter("a_id <> b_id")
    gaps = pairs.groupBy(*PAGE, F.col("a_id").alias("block_no")).agg(F.min(Box.of("a_").gap(Box.of("b_"))).alias("gap"))
    rows = blocks.join(gaps, [*PAGE, "block_no"], "left")
    box, half = Box.of(), F.coalesce(F.col("gap") / 2, F.lit(float("inf")))
    x, y = F.least(box.width * share, half), F.least(box.height * share, half)
    return rows.select(*PAGE, "block_no", (box.x0 - x).alias("x0"), (box.y0 - y).alias("y0"), (box.x1 + x).alias("x1"), (box.y1 + y).alias("y1"))


def reading_order(lines: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """Lines with ``place``: rows of nearly the same top from left to right."""
    w = Window.partitionBy(*PAGE).orderBy(reading_row("y0", tolerance), "x0", "line_no")
    return lines.withColumn("place", F.row_number().over(w) - 1)


def list_groups(blocks: DataFrame, page_height: float, most: float = 0.1) -> DataFrame:
    """List items with ``group_no``: neighbours in order with a gap under ``most`` of the page; lone ones are ``text``."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    item = F.col("kind") == "list"
    starts = item & ~(F.coalesce(F.lag(item).over(w), F.lit(False)) & (F.col("y0") - F.lag("y1").over(w) < page_height * most))
    rows = blocks.withColumn("group_no", F.when(item, F.sum(starts.cast("int")).over(w)))
    n = F.count("*").over(Window.partitionBy(*PAGE, "group_no"))
    return rows.withColumn("kind", F.when(item & (n == 1), "text").otherwise(F.col("kind")))


def caption_owner(blocks: DataFrame, page_height: float, owners: tuple[str, ...] = ("table", "figure"), most: float = 0.05) -> DataFrame:
    """``doc_id, page, pos, owner_pos``: each caption's owner, the block before it if that is near enough, else the one after."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    rows = blocks.withColumn("before", F.lag(F.struct("pos", "kind", "y1")).over(w)).withColumn("after", F.lead(F.struct("pos", "kind", "y0")).over(w))
    up = F.col("before.kind").isin(*owners) & (F.col("y0") - F.col("before.y1") < page_height * most)
    down = F.col("after.kind").isin(*owners) & (F.col("after.y0") - F.col("y1") < page_height * most)
    return rows.filter("kind = 'caption'").select(*PAGE, "pos", F.when(up, F.col("before.pos")).when(down, F.col("after.pos")).alias("owner_pos"))


def continued(blocks: DataFrame, ignored: tuple[str, ...] = ("header", "footer")) -> DataFrame:
    """Text blocks with ``goes_on``: the next block that counts is text too, elsewhere, and begins in lower case after no
    full stop."""
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    rows = blocks.filter(~F.col("kind").isin(*ignored)).withColumn("next", F.lead(F.struct("kind", "page", "y0", "text")).over(w))
    elsewhere = (F.col("next.page") > F.col("page")) | (F.col("next.y0") < F.col("y0"))
    open_end, low = ~F.col("text").rlike(r"[.!?。！？]\s*$"), F.col("next.text").rlike(r"^\s*\p{Ll}")
    return rows.withColumn("goes_on", F.coalesce((F.col("kind") == "text") & (F.col("next.kind") == "text") & elsewhere & open_end & low, F.lit(False))).drop("next")


def dehyphenated(lines: DataFrame) -> DataFrame:
    """``doc_id, page, text``: lines joined; a hyphen at a line's end goes where the next line begins in lower case."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    cut = F.col("text").rlike(r"[-—¬]\s?$") & F.coalesce(F.lead("text").over(w).rlike(r"^\s?\p{Ll}"), F.lit(False))
    piece = F.when(cut, F.regexp_replace("text", r"[-—¬]\s?$", "")).otherwise(F.concat("text", F.lit(" ")))
    rows = lines.withColumn("piece", piece)
    return rows.groupBy(*PAGE).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "")).alias("text"))


def islands(rows: DataFrame, by: list[str], order: str, same: Column) -> DataFrame:
    """Rows with ``island``: a new one starts wherever ``same`` (this row goes on from the one before) is not true."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))


def missing_blocks(lines: DataFrame, most: float = 20.0) -> DataFrame:
    """Unassigned lines with ``island``: neighbours by number and distance form one block."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    near = (F.col("line_no") - F.lag("line_no").over(w) == 1) & (F.abs(F.col("y0") - F.lag("y1").over(w)) < most)
    return islands(lines, PAGE, "line_no", near)


def table_size(cells: DataFrame) -> DataFrame:
    """``table_id, n_rows, n_cols``: the largest sum of spans in a column and in a row."""
    rows = cells.groupBy("table_id", "col_id").agg(F.sum("rowspan").alias("n")).groupBy("table_id").agg(F.max("n").alias("n_rows"))
    cols = cells.groupBy("table_id", "row_id").agg(F.sum("colspan").alias("n")).groupBy("table_id").agg(F.max("n").alias("n_cols"))
    return rows.join(cols, "table_id")


def table_grid(cells: DataFrame) -> DataFrame:
    """``table_id, row_id, line``: Markdown rows; a cell with spans fills its first place, the rest is blank."""
    places = cells.withColumn("r", F.explode(F.sequence(F.col("row_id"), F.col("row_id") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col_id"), F.col("col_id") + F.col("colspan") - 1)))
    text = F.when((F.col("r") == F.col("row_id")) & (F.col("c") == F.col("col_id")), F.col("text")).otherwise("")
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", text.alias("t")))), lambda x: x["t"]), " | ")
    return places.groupBy("table_id", F.col("r").alias("row_id")).agg(F.concat(F.lit("| "), row, F.lit(" |")).alias("line"))


def split_rows(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """Cells of several text lines split into rows, where at least ``share`` of a table's rows can be: all their cells
    have the same number of lines. Rows below move down by what was added above."""
    rows = cells.withColumn("k", F.size("lines"))
    per_row = rows.groupBy("table_id", "row_id").agg(F.max("k").alias("n"), (F.min("k") == F.max("k")).alias("even")).withColumn("can", F.col("even") & (F.col("n") > 1))
    w = Window.partitionBy("table_id")
    per_row = per_row.withColumn("use", F.col("can") & (F.avg(F.col("can").cast("int")).over(w) >= share))
    shift = F.coalesce(F.sum(F.when(F.col("use"), F.col("n") - 1).otherwise(0)).over(w.orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(per_row.withColumn("shift", shift).select("table_id", "row_id", "use", "shift"), ["table_id", "row_id"])
    parts = F.when(F.col("use"), F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("text")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.array_join("lines", " ").alias("text"))))
    return rows.select("table_id", "row_id", "col_id", "shift", F.explode(parts).alias("p")).select("table_id", (F.col("row_id") + F.col("shift") + F.col("p.i")).alias("row_id"), "col_id", F.col("p.text").alias("text"))


def numbered_lines(spans: DataFrame, share: float = 0.6) -> DataFrame:
    """Pages whose lines mostly begin with a number: ``doc_id, page, share``."""
    left = spans.groupBy(*PAGE, "line_no").agg(F.min_by("text", "x0").alias("left"))
    return left.groupBy(*PAGE).agg(F.avg(F.trim("left").rlike(r"^\p{Nd}+$").cast("int")).alias("share")).filter(F.col("share") > share)


def heading_levels(headings: DataFrame, levels: int = 4) -> DataFrame:
    """``doc_id, pos, level``: a document's heading heights in ``levels`` groups, the tallest first.

    Groups minimise the squares within (one-dimensional k-means, solved exactly); a document's headings are one group.
    Heights count in hundredths, which bounds the distinct ones of a page's format.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, {}

        def out(rows: pa.Table) -> pa.RecordBatch:
            heights = rows.column("height").to_numpy()
            level = np.empty(len(heights), np.int32)
            starts = document_starts(rows.column("doc_id"))
            for a, b in zip(starts, [*starts[1:], len(heights)], strict=True):
                own, at, counts = np.unique(-heights[a:b], return_inverse=True, return_counts=True)
                key = (own.tobytes(), counts.tobytes())
                if key not in known:  # documents of one format have the same heights
                    if len(known) >= 10_000:
                        known.clear()
                    known[key] = np.repeat(np.arange(1, min(levels, len(own)) + 1), np.diff(best_cuts(-own, counts.astype(float), min(levels, len(own)))))
                level[a:b] = known[key][at]
            return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("pos").combine_chunks(), pa.array(level)], names=["doc_id", "pos", "level"])

        for part in parts:
            rows = pa.Table.from_batches([part])
            held = rows if held is None else pa.concat_tables([held, rows])
            cut = int(document_starts(rows.column("doc_id"))[-1]) if part.num_rows else 0
            if cut:  # what comes before the part's last document is whole
                cut += held.num_rows - part.num_rows
                yield out(held[:cut])
                held = held[cut:]
        if held is not None and held.num_rows:
            yield out(held)

    headings = headings.select("doc_id", "pos", F.round("height", 2).cast("double").alias("height")).repartition("doc_id").sortWithinPartitions("doc_id")
    return headings.mapInArrow(run, f"doc_id {headings.schema['doc_id'].dataType.simpleString()}, pos {headings.schema['pos'].dataType.simpleString()}, level int")


def document_starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where each document of rows in order begins; null ids are one document."""
    codes = ids.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


def best_cuts(values: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Where to cut ordered values into ``k`` runs with the least weighted squares, by dynamic programming."""
    n = len(values)
    w, s, q = (np.concatenate(([0.0], np.cumsum(x))) for x in (weights, weights * values, weights * values**2))
    cost = lambda a, b: (q[b] - q[a]) - (s[b] - s[a]) ** 2 / (w[b] - w[a])
    best = np.full((k + 1, n + 1), np.inf)
    back = np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0.0
    for j in range(1, k + 1):
        for b in range(j, n + 1):
            a = np.arange(j - 1, b)
            options = best[j - 1, a] + cost(a, b)
            at = int(np.argmin(options))
            best[j, b], back[j, b] = options[at], at + j - 1
    cuts = [n]
    for j in range(k, 0, -1):
        cuts.append(int(back[j, cuts[-1]]))
    return cuts[::-1]


def blockquotes(blocks: DataFrame) -> DataFrame:
    """Blocks with ``quote_level``: a block further right than the one before is quoted one deeper, one further left ends it."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x0")))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).alias("level"), F.array().cast("array<struct<pos:int,level:int>>").alias("out"))

    def step(state: Column, b: Column) -> Column:
        level = F.when(state["x"].isNull(), 0).when(b["x0"] > state["x"] + 5, state["level"] + 1).when(b["x0"] < state["x"] - 5, F.greatest(F.lit(0), state["level"] - 1)).otherwise(state["level"])
        return F.struct(b["x0"].alias("x"), level.alias("level"), F.concat(state["out"], F.array(F.struct(b["pos"].alias("pos"), level.alias("level")))).alias("out"))

    return blocks.groupBy(*PAGE).agg(F.aggregate(ordered, start, step)["out"].alias("out")).select(*PAGE, F.explode("out").alias("o")).select(*PAGE, "o.pos", F.col("o.level").alias("quote_level"))


def code_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, page, text``: code with its indentation, from the left edge and the mean width of a character."""
    w = Window.partitionBy(*PAGE)
    width = F.sum(F.col("x1") - F.col("x0")).over(w) / F.greatest(F.sum(F.length("text")).over(w), F.lit(1))
    indent = F.floor((F.col("x0") - F.min("x0").over(w)) / F.greatest(width, F.lit(0.001))).cast("int")
    rows = lines.withColumn("out", F.concat(F.repeat(F.lit(" "), indent), "text"))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "out"))), lambda x: x["out"]), "\n").alias("text"))


def descendants(tree: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``doc_id, block_id, ancestor``: blocks of these kinds under each block, not through removed ones.

    The tree is ``doc_id, block_id, parent_id, kind, removed``. Links are doubled until nothing new is reached, so the
    number of joins grows with the logarithm of the depth, which has no bound; a link into a cycle ends there. Each round
    is checkpointed where the session has a checkpoint folder.
    """
    spark = tree.sparkSession
    alive = tree.filter("NOT removed")
    top = alive.filter("parent_id IS NOT NULL").select("doc_id", "block_id", F.col("parent_id").alias("ancestor"))
    known, before = top, -1
    while (n := known.count()) != before:
        before = n
        further = known.join(known.select("doc_id", F.col("block_id").alias("ancestor"), F.col("ancestor").alias("next")), ["doc_id", "ancestor"]).select("doc_id", "block_id", F.col("next").alias("ancestor"))
        known = known.unionByName(further).distinct()
        known = known.checkpoint() if spark.sparkContext.getCheckpointDir() else known
    return known.join(alive.filter(F.col("kind").isin(*kinds)).select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi").select("doc_id", "block_id", "ancestor")


def subtitles(spans: DataFrame, titles: DataFrame, close: float = 0.1, ratio: float = 5.0) -> DataFrame:
    """``doc_id, subtitle`` of covers: the first text of the second largest size at most ``ratio`` sizes under the title.

    ``titles(doc_id, size, y1)`` of page 0.
    """
    rows = spans.filter("page = 0").join(titles.select("doc_id", F.col("size").alias("t_size"), F.col("y1").alias("t_y1")), "doc_id").filter(F.col("size") < F.col("t_size") - close)
    second = F.max("size").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("second", second).filter(F.abs(F.col("size") - F.col("second")) < close)
    under = (F.col("y0") - F.col("t_y1") >= 0) & (F.col("y0") - F.col("t_y1") <= F.col("second") * ratio)
    return rows.filter(under).groupBy("doc_id").agg(F.min_by("text", F.struct("y0", "span_no")).alias("subtitle"))


def placed_orphans(blocks: DataFrame, orphans: DataFrame, y_weight: float = 5.0) -> DataFrame:
    """``doc_id, page, block_no, place``: blocks in order with each orphan behind the nearest block."""
    best = nearest(side(orphans, "a_", "block_no"), side(blocks, "b_", "block_no"), lambda a, b: a.center_distance(b, y_weight=y_weight, absolute=True), lambda w, h: F.least(w, h * y_weight))
    anchor = best.select(*PAGE, F.col("a_id").alias("block_no"), F.col("b_id").alias("anchor"))
    every = blocks.select(*PAGE, "block_no", F.col("block_no").alias("anchor"), F.lit(0).alias("late")).unionByName(orphans.select(*PAGE, "block_no").join(anchor, [*PAGE, "block_no"], "left").select(*PAGE, "block_no", "anchor", F.lit(1).alias("late")))
    w = Window.partitionBy(*PAGE).orderBy(F.asc_nulls_last("anchor"), "late", "block_no")
    return every.withColumn("place", F.row_number().over(w) - 1).select(*PAGE, "block_no", "place")


def fitted_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells as large as the lines that were assigned to them (``lines(doc_id, page, cell_no, x0..y1)``)."""
    own = merged_boxes(lines, [*PAGE, "cell_no"]).select(*PAGE, "cell_no", *(F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    rows = cells.join(own, [*PAGE, "cell_no"], "left")
    return rows.select(*PAGE, "cell_no", *(f(F.col(c), F.coalesce(f"l_{c}", c)).alias(c) for c, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))))


def merged_dollar_columns(cells: DataFrame) -> DataFrame:
    """Cells without columns of dollar signs: a column of nothing but ``$`` or blanks, without spans, whose right
    neighbour has the same rows, joins that neighbour; columns to the right move left."""
    per_col = cells.groupBy("table_id", "col_id").agg(F.every(F.trim("text").isin("", "$")).alias("dollars"), F.max("colspan").alias("widest"), F.count("*").alias("n"), F.array_sort(F.collect_list("row_id")).alias("rows"))
    into = cells.select("table_id", F.explode_outer(F.when(F.col("colspan") > 1, F.sequence(F.col("col_id") + 1, F.col("col_id") + F.col("colspan") - 1))).alias("col_id")).filter("col_id IS NOT NULL").distinct().withColumn("spanned", F.lit(True))
    following = per_col.select("table_id", (F.col("col_id") - 1).alias("col_id"), F.col("rows").alias("next_rows"))
    cols = per_col.join(into, ["table_id", "col_id"], "left").join(following, ["table_id", "col_id"], "left")
    use = F.col("dollars") & (F.col("n") > 1) & (F.col("widest") == 1) & F.col("spanned").isNull() & F.coalesce(F.col("rows") == F.col("next_rows"), F.lit(False))
    w = Window.partitionBy("table_id").orderBy("col_id")
    cols = cols.withColumn("use", use).withColumn("shift", F.sum(F.col("use").cast("int")).over(w)).select("table_id", "col_id", "use", "shift")
    rows = cells.join(cols, ["table_id", "col_id"])
    before = rows.filter("use").select("table_id", "row_id", (F.col("col_id") + 1).alias("col_id"), F.col("text").alias("sign"))
    out = rows.filter("NOT use").join(before, ["table_id", "row_id", "col_id"], "left")
    return out.select("table_id", "row_id", (F.col("col_id") - F.col("shift")).alias("col_id"), F.concat(F.coalesce("sign", F.lit("")), "text").alias("text"))


def table_runs(tables: DataFrame, page_height: float, tall: float = 0.6, near: float = 20.0) -> DataFrame:
    """Tables with ``island``: those that go on across pages (alone there and tall) or beside and under each other.

    ``tables(doc_id, page, pos, x0..y1, n_rows, n_cols)``. A row match always counts, as in the rule's own wording.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    rows = tables.withColumn("alone", F.count("*").over(Window.partitionBy(*PAGE)) == 1).withColumn("p", F.lag(F.struct("page", "x0", "y0", "x1", "y1", "n_cols", "alone")).over(w))
    height, width = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    p_height, p_width = F.col("p.y1") - F.col("p.y0"), F.col("p.x1") - F.col("p.x0")
    across = (F.col("p.page") == F.col("page") - 1) & (F.greatest(height, p_height) / page_height > tall) & (F.col("alone") | F.col("p.alone"))
    beside = (F.col("p.page") == F.col("page")) & (p_height / height).between(0.75, 1.25) & (F.abs(F.col("x0") - F.col("p.x1")) < near) & (F.abs(F.col("y0") - F.col("p.y0")) < near)
    under = (F.col("p.page") == F.col("page")) & (p_width / width).between(0.75, 1.25) & (F.abs(F.col("y0") - F.col("p.y1")) < near) & (F.abs(F.col("x0") - F.col("p.x0")) < near) & (F.abs(F.col("n_cols") - F.col("p.n_cols")) < 2)
    return rows.withColumn("island", F.sum(F.when(F.coalesce(across | beside | under, F.lit(False)), 0).otherwise(1)).over(w)).drop("p", "alone")


def nested_lists(items: DataFrame, page_width: float, least: float = 0.01) -> DataFrame:
    """List items with ``level``: the number of open items further left; an item closes those that are not.

    A fold over each group's items in order that carries the stack of left edges.
    """
    step_x = page_width * least
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x0")))
    start = F.struct(F.array().cast("array<double>").alias("stack"), F.array().cast("array<struct<pos:int,level:int>>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        opened = F.filter(state["stack"], lambda x: x + step_x < item["x0"])
        return F.struct(F.concat(opened, F.array(item["x0"])).alias("stack"), F.concat(state["out"], F.array(F.struct(item["pos"].alias("pos"), F.size(opened).alias("level")))).alias("out"))

    return items.groupBy("doc_id", "group_no").agg(F.aggregate(ordered, start, step)["out"].alias("out")).select("doc_id", "group_no", F.explode("out").alias("o")).select("doc_id", "group_no", "o.*")


def ordered_by_offset(blocks: DataFrame) -> DataFrame:
    """Blocks with ``place``: by the mean offset of their characters; blocks without one stand behind the last that has
    one, or before the first."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    before = F.last("offset", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("offset", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    key = F.coalesce("offset", before, after - 0.5, F.lit(0.0))
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key, F.col("offset").isNull(), "pos")) - 1)


def footnotes_last(blocks: DataFrame) -> DataFrame:
    """Blocks with ``place``: page headers first, footnotes last, the rest in order between."""
    rank = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "footnote", 2).otherwise(1)
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank, "pos")) - 1)


def table_of_contents(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'heading'").select("doc_id", "page", "pos", F.trim("text").alias("title"), "y0").orderBy("doc_id", "page", "pos")


def number_edges(spans: DataFrame, share: float = 0.6, least_lines: int = 4, least_rest: int = 10) -> DataFrame:
    """``doc_id, page, block_no, line_no, span_no``: line numbers at the starts or ends of a block's lines.

    ``spans(doc_id, page, block_no, line_no, span_no, text)``. A line starts (ends) with a number if it has several spans,
    its first (last) is digits only and more than ``least_rest`` characters are left; in blocks of ``least_lines`` or more,
    of whose lines more than ``share`` do, those spans are line numbers.
    """
    by_line = Window.partitionBy(*PAGE, "block_no", "line_no")
    rows = spans.withColumn("n", F.count("*").over(by_line)).withColumn("k", F.row_number().over(by_line.orderBy("span_no"))).withColumn("chars", F.sum(F.length("text")).over(by_line))
    digits = F.trim("text").rlike(r"^\p{Nd}+$") & (F.col("n") > 1) & (F.col("chars") - F.length(F.trim("text")) > least_rest)
    block = Window.partitionBy(*PAGE, "block_no")
    lines = F.count_if(F.col("k") == 1).over(block)
    first, last = digits & (F.col("k") == 1), digits & (F.col("k") == F.col("n"))
    rows = rows.withColumn("first", first & (lines >= least_lines) & (F.count_if(first).over(block) / lines > share)).withColumn("last", last & (lines >= least_lines) & (F.count_if(last).over(block) / lines > share))
    return rows.filter("first OR last").select(*PAGE, "block_no", "line_no", "span_no")


def number_blocks(blocks: DataFrame, share: float = 0.6, least: int = 4) -> DataFrame:
    """``doc_id, page, block_no``: blocks taller than wide whose words, ``least`` or more, are mostly digits."""
    words = F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda w: w != "")
    digits = F.size(F.filter("words", lambda w: w.rlike(r"^\p{Nd}+$")))
    rows = blocks.withColumn("words", words).filter((F.size("words") >= least) & (digits / F.size("words") > share) & (Box.of().height > Box.of().width))
    return rows.select(*PAGE, "block_no")


def aligned_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, page, cell_no, x0..y1``: cells as tall as the lines that are theirs, and clear of other cells' lines.

    A line belongs to the cell with its largest overlap, of equal ones the first. Then a cell's top moves below the
    bottom of the topmost line in it that belongs elsewhere, and its bottom above the top of the lowest such line, where
    something is left between.
    """
    pairs = side(lines, "a_", "line_no").join(side(cells, "b_", "cell_no"), PAGE).filter(Box.of("a_").meets(Box.of("b_")))
    area = Box.of("a_").intersection(Box.of("b_"))
    best = F.row_number().over(Window.partitionBy(*PAGE, "a_id").orderBy(F.desc(area), "b_id")) == 1
    pairs = pairs.withColumn("own", best)
    own, other = F.col("own"), ~F.col("own")
    reach = pairs.groupBy(*PAGE, F.col("b_id").alias("cell_no")).agg(
        F.min(F.when(own, F.col("a_y0"))).alias("low"), F.max(F.when(own, F.col("a_y1"))).alias("high"),
        F.min_by(F.when(other, F.col("a_y1")), F.when(other, F.struct("a_y0", "a_id"))).alias("under"), F.max_by(F.when(other, F.col("a_y0")), F.when(other, F.struct(F.col("a_y1"), -F.col("a_id")))).alias("over"),
    )
    rows = cells.join(reach, [*PAGE, "cell_no"], "left")
    y0, y1 = F.least("y0", F.coalesce("low", "y0")), F.greatest("y1", F.coalesce("high", "y1"))
    new0, new1 = F.greatest(y0, F.coalesce("under", y0)), F.least(y1, F.coalesce("over", y1))
    fits = F.col("under").isNotNull() & (new0 < new1)
    return rows.select(*PAGE, "cell_no", "x0", F.when(fits, new0).otherwise(y0).alias("y0"), "x1", F.when(fits, new1).otherwise(y1).alias("y1"))


def off_page(lines: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """Pages with a line that is not within the page."""
    outside = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height)
    return lines.filter(outside).select(*PAGE).distinct()


def relinked(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Spans with ``url``: each link goes to the first span of its page whose text holds the link's, and to that only;
    of several links for a span the first counts. ``links(doc_id, page, link_no, link_text, url)``."""
    own = links.withColumn("link_text", F.trim("link_text")).filter("link_text <> ''")
    pairs = spans.select(*PAGE, "span_no", "text").join(own, PAGE).filter(F.contains(F.col("text"), F.col("link_text")))
    first = pairs.groupBy(*PAGE, "link_no").agg(F.min_by(F.struct("span_no", "url"), "span_no").alias("s"))
    chosen = first.groupBy(*PAGE, F.col("s.span_no").alias("span_no")).agg(F.min_by("s.url", "link_no").alias("url"))
    return spans.join(chosen, [*PAGE, "span_no"], "left")


def interleaved(headings: DataFrame, body: DataFrame) -> DataFrame:
    """``doc_id, page, text``: inline headings and body lines by their tops; at the same height headings come first."""
    every = headings.select(*PAGE, "y0", F.lit(0).alias("src"), "seq", "text").unionByName(body.select(*PAGE, "y0", F.lit(1).alias("src"), "seq", "text"))
    return every.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "src", "seq", "text"))), lambda x: x["text"]), "\n").alias("text"))


def raw_text(spans: DataFrame) -> DataFrame:
    """``doc_id, page, block_no, text``: a block's spans in order, with a line break after each line.

    Spans are rows ``span_no, text`` of a line, or its array ``spans`` of both. An array is joined in its row, so a line is one
    row in the one shuffle there is; rows of spans are collected once, for their block.
    """
    if "spans" in spans.columns:
        line = F.array_join(F.transform(F.array_sort("spans"), lambda x: x["text"]), "")
        rows = spans.select(*PAGE, "block_no", F.struct("line_no", F.concat(line, F.lit("\n")).alias("text")).alias("own"))
    else:
        rows = spans.select(*PAGE, "block_no", F.struct("line_no", "span_no", "text").alias("own"))

    def text(own: Column) -> Column:
        if "spans" in spans.columns:
            return F.array_join(F.transform(own, lambda x: x["text"]), "")
        last = lambda x, i: ~F.get(own, i + 1)["line_no"].eqNullSafe(x["line_no"]) | (i + 1 == F.size(own))
        return F.array_join(F.transform(own, lambda x, i: F.concat(F.coalesce(x["text"], F.lit("")), F.when(last(x, i), "\n").otherwise(""))), "")

    grouped = rows.groupBy(*PAGE, "block_no").agg(F.array_sort(F.collect_list("own")).alias("own"))
    return grouped.select(*PAGE, "block_no", text(F.col("own")).alias("text"))


def placed_boxes(boxes: DataFrame, labels: tuple[str, ...], x: Column | float, y: Column | float, width: Column | float, height: Column | float) -> DataFrame:
    """Detected boxes of known labels, rescaled to the page, kept within it, with ``place`` by their position."""
    box = Box.of().rescaled(x, y).within(Box(F.lit(0.0), F.lit(0.0), *(s if isinstance(s, Column) else F.lit(float(s)) for s in (width, height))))
    rows = boxes.filter(F.col("label").isin(*labels)).select(*PAGE, "position", "label", box.x0.alias("x0"), box.y0.alias("y0"), box.x1.alias("x1"), box.y1.alias("y1"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("position")) - 1)


def ordered_lines(lines: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """Lines with ``place`` in their block: by index, or by reading order where a block mixes ways of extraction (``method``)."""
    block = Window.partitionBy(*PAGE, "block_no")
    mixed = F.size(F.collect_set("method").over(block)) > 1
    rows = lines.withColumn("_m", mixed)
    key = [F.when(F.col("_m"), reading_row("y0", tolerance)), F.when(F.col("_m"), F.col("x0")), F.col("line_no")]
    return rows.withColumn("place", F.row_number().over(block.orderBy(*key)) - 1).drop("_m")


def of_kinds(blocks: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Only blocks of these kinds at the top of their page (``parent_id`` null)."""
    return blocks.filter(F.col("parent_id").isNull() & F.col("kind").isin(*kinds))
