"""What surrounds a recogniser: which pieces of a page it reads, lines that belong to one formula, long tables in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.geometry import Box
from paperloom.operators.layout import PAGE
from paperloom.operators.tiles import meeting_pairs

#: The kinds of blocks that may be read whole.
WHOLE_KINDS = ["SectionHeader", "ListItem", "Footnote", "Text", "TextInlineMath", "Code", "Caption"]


def read_by_mode(blocks: DataFrame, lines: DataFrame, overlaps: DataFrame, most_overlap: float = 0.5, most_lines: int = 15, most_height: float = 0.5, kinds: list[str] = WHOLE_KINDS) -> DataFrame:
    """``doc_id, page, block_no, line_no``: what is read, whole blocks (``line_no`` null) or the lines of a block.

    ``blocks(doc_id, page, block_no, kind, height, page_height)``, ``lines(doc_id, page, block_no, line_no)`` and the largest mutual
    ``overlaps(doc_id, page, share)`` of a page's blocks. A block is read by its lines where the page's blocks overlap more than
    ``most_overlap``, where its kind is not read whole, where it has more than ``most_lines`` lines, or where it takes
    ``most_height`` of the page or more. A block by lines that has none is not read.
    """
    counts = lines.groupBy(*PAGE, "block_no").agg(F.count("*").alias("n_lines"))
    rows = blocks.join(overlaps.select(*PAGE, "share"), PAGE, "left").join(counts, [*PAGE, "block_no"], "left")
    by_line = (F.coalesce("share", F.lit(0.0)) > most_overlap) | ~F.col("kind").isin(kinds) | (F.coalesce("n_lines", F.lit(0)) > most_lines) | (F.col("height") >= F.col("page_height") * most_height)
    rows = rows.select(*PAGE, "block_no", F.coalesce(by_line, F.lit(True)).alias("by_line"))
    whole = rows.filter("NOT by_line").select(*PAGE, "block_no", F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no"))
    return whole.unionByName(rows.filter("by_line").join(lines.select(*PAGE, "block_no", "line_no"), [*PAGE, "block_no"]).select(*PAGE, "block_no", "line_no"))


def merged_lines(lines: DataFrame, expand: float = 0.05, least: float = 0.015, same_row: float = 0.8, alone: float = 0.5) -> DataFrame:
    """``doc_id, page, block_no, head_no, line_no``: runs of a block's lines that are pieces of one line, as a formula is cut by its fonts.

    ``lines(doc_id, page, block_no, line_no, x0..y1)``, ``line_no`` unique in a page. Lines are looked at in order, those more than
    five times as high as wide left out. A line joins the run before it if it covers, widened by ``expand`` to both sides,
    ``least`` of its area with the run's lines, stands with more than ``same_row`` of its height in the row of the run's first, and
    overlaps nothing else as much: more than ``alone`` of its overlaps, but for that with the next line, are with the run. A
    line that does not join ends the run and begins none itself; the line after it does. Runs of one line are none.

    Overlaps come from a join in tiles; the rest is a fold over a block's lines with the run's first line as its state.
    """
    place = F.row_number().over(Window.partitionBy(*PAGE, "block_no").orderBy("line_no")).cast("int")
    rows = lines.filter((F.col("x1") - F.col("x0")) * 5 > F.col("y1") - F.col("y0")).withColumn("i", place)
    wide = Box.of().expanded(expand, 0)
    side = lambda p: rows.select(*PAGE, F.struct("block_no", "i").alias(f"{p}id"), wide.x0.alias(f"{p}x0"), wide.y0.alias(f"{p}y0"), wide.x1.alias(f"{p}x1"), wide.y1.alias(f"{p}y1"))
    pairs = meeting_pairs(side("a_"), side("b_")).filter("a_id.block_no = b_id.block_no AND a_id.i <> b_id.i AND b_id.i <> a_id.i + 1")
    area = Box.of("a_").intersection(Box.of("b_"))
    found = pairs.groupBy(*PAGE, F.col("a_id.block_no").alias("block_no"), F.col("a_id.i").alias("i")).agg(F.sum(area).alias("total"), F.collect_list(F.struct(F.col("b_id.i").alias("j"), area.alias("area"))).alias("others"))
    whole = rows.join(found, [*PAGE, "block_no", "i"], "left")
    line = F.struct("i", "line_no", "y0", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("others", F.array().cast("array<struct<j:int,area:double>>")).alias("others"))
    number = lines.schema["line_no"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("start"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), F.lit(None).cast(number).alias("head"), F.array().cast(f"array<struct<head_no:{number},line_no:{number}>>").alias("out"))

    def step(state: Column, own: Column) -> Column:
        in_run = F.filter(own["others"], lambda o: (o["j"] >= state["start"]) & (o["j"] < own["i"]))
        shared = F.aggregate(in_run, F.lit(0.0), lambda s, o: s + o["area"])
        row = F.greatest(F.lit(0.0), F.least(state["y1"], own["y1"]) - F.greatest(state["y0"], own["y0"])) / F.greatest(F.lit(1.0), own["y1"] - own["y0"])
        joins = (shared / F.greatest(F.lit(1.0), own["area"]) >= least) & (row > same_row) & (shared / F.greatest(F.lit(1.0), own["total"]) > alone)
        idle = state["start"] == 0
        member = F.struct(F.when(idle, own["line_no"]).otherwise(state["head"]).alias("head_no"), own["line_no"].alias("line_no"))
        return F.struct(
            F.when(idle, own["i"]).when(joins, state["start"]).otherwise(0).alias("start"), F.when(idle, own["y0"]).otherwise(state["y0"]).alias("y0"), F.when(idle, own["y1"]).otherwise(state["y1"]).alias("y1"),
            F.when(idle, own["line_no"]).otherwise(state["head"]).alias("head"), F.when(idle | joins, F.concat(state["out"], F.array(member))).otherwise(state["out"]).alias("out"),
        )

    folded = whole.groupBy(*PAGE, "block_no").agg(F.aggregate(F.array_sort(F.collect_list(line)), start, step)["out"].alias("out"))
    members = folded.select(*PAGE, "block_no", F.inline("out"))
    return members.withColumn("n", F.count("*").over(Window.partitionBy(*PAGE, "block_no", "head_no"))).filter("n > 1").drop("n")


def row_batches(cells: DataFrame, size: int = 60, most: int = 175) -> DataFrame:
    """Cells ``table_id, row_id`` with ``batch``: the tables' rows in batches of ``size``; tables of more than ``most`` rows are left out."""
    place = F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_id"))
    rows = cells.withColumn("_place", place)
    rows = rows.withColumn("_n", F.max("_place").over(Window.partitionBy("table_id")))
    return rows.filter(F.col("_n") <= most).withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place", "_n")


def batches_joined(cells: DataFrame) -> DataFrame:
    """Cells ``table_id, batch, row_id`` that came back batch by batch, with the row they have in the whole table.

    A batch is moved down by the last row of what was joined before it, so a batch's row 0 falls on that row, and its row 1
    comes after it: rows of batches count from 1. The moves add up by a fold over a table's batches, of which there are few.
    """
    lasts = cells.groupBy("table_id", "batch").agg(F.max("row_id").cast("long").alias("last"))
    start = F.struct(F.lit(0).cast("long").alias("shift"), F.array().cast("array<struct<batch:int,shift:bigint>>").alias("out"))

    def step(state: Column, own: Column) -> Column:
        moved = F.concat(state["out"], F.array(F.struct(own["batch"].alias("batch"), state["shift"].alias("shift"))))
        return F.struct((state["shift"] + own["last"] + state["shift"]).alias("shift"), moved.alias("out"))

    shifts = lasts.groupBy("table_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct(F.col("batch").cast("int").alias("batch"), "last"))), start, step)["out"].alias("out")).select("table_id", F.inline("out"))
    return cells.join(shifts, ["table_id", "batch"]).withColumn("row_id", F.col("row_id") + F.col("shift")).drop("shift", "batch")
