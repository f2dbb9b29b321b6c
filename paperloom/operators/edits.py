"""The log of edits to a file's images: deletions that are undone last in, first out, and replaced blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.shares import ROWS, shares
from paperloom.sources.scratch import written


def matched_edits(log: DataFrame, by: str = "file_key") -> DataFrame:
    """The deletions of a log ``by, entry_id, action, path`` with ``undone_by``, the entry that took each back, and ``state``.

    ``delete`` puts a path on the file's stack, ``undo`` takes the last one back, ``undo_all`` takes back all that are left,
    ``save`` empties the stack, so that what was on it stays deleted. An undo of an empty stack does nothing. States are
    ``restored``, ``deleted`` (it can still be undone) and ``saved``.

    The running depth of a stack tells its levels; between two entries that empty the stack, deletions and undos of a
    level take turns, so a deletion's undo is the next entry of its level.
    """
    order = Window.partitionBy(by).orderBy("entry_id")
    ends = F.col("action").isin("undo_all", "save")
    before = F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.filter(F.col("action").isin("delete", "undo", "undo_all", "save")).withColumn("part", before)
    part = Window.partitionBy(by, "part").orderBy("entry_id")
    step = F.when(F.col("action") == "delete", 1).when(F.col("action") == "undo", -1).otherwise(0)
    rows = rows.withColumn("sum", F.sum(step).over(part)).withColumn("low", F.least(F.lit(0), F.min("sum").over(part)))
    # The floor falls where an undo meets an empty stack.
    rows = rows.withColumn("idle", (F.col("action") == "undo") & (F.col("low") < F.coalesce(F.lag("low").over(part), F.lit(0))))
    rows = rows.withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("action") == "undo", 1).otherwise(0)).filter(~F.col("idle"))
    closing = rows.filter(ends).select(by, "part", F.col("entry_id").alias("end_id"), F.col("action").alias("end"))
    level = Window.partitionBy(by, "part", "level").orderBy("entry_id")
    turns = rows.filter(~ends).withColumn("undo_id", F.lead("entry_id").over(level)).filter("action = 'delete'").join(closing, [by, "part"], "left")
    undone = F.coalesce("undo_id", F.when(F.col("end") == "undo_all", F.col("end_id")))
    state = F.when(F.col("undo_id").isNotNull() | (F.col("end") == "undo_all"), "restored").when(F.col("end") == "save", "saved").otherwise("deleted")
    return turns.select(by, "entry_id", "path", undone.alias("undone_by"), state.alias("state"))


def image_states(log: DataFrame, by: str = "file_key") -> DataFrame:
    """``by, path, trashed``: whether an image is in the trash, which its last deletion tells."""
    last = matched_edits(log, by).groupBy(by, "path").agg(F.max_by("state", "entry_id").alias("state"))
    return last.select(by, "path", (F.col("state") != "restored").alias("trashed"))


def linked_edits(replaced: DataFrame, by: str = "doc_id") -> DataFrame:
    """Replacements ``by, seq, old_id, new_id`` with ``next``, the first later one that takes the new block away, in shares."""
    event = written(replaced.select(by, "seq", "old_id", "new_id"), "edits")
    made = F.struct(F.col("new_id").alias("id"), F.lit(False).alias("use"))
    use = F.struct(F.col("old_id").alias("id"), F.lit(True).alias("use"))
    both = event.select("*", F.inline(F.array(made, use))).repartition(shares(event, ROWS // 2), by, "id")
    # Of equal seq a block's making comes first, so that an edit is not its own next one.
    later = Window.partitionBy(by, "id").orderBy(F.desc("seq"), "use").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_use = F.last(F.when(F.col("use") & F.col("id").isNotNull(), F.col("seq")), ignorenulls=True).over(later)
    return both.withColumn("next", next_use).filter(~F.col("use")).select(by, "seq", "old_id", "new_id", "next")


def ends_of(replaced: DataFrame, by: str = "doc_id") -> DataFrame:
    """``by, block_id, end_id``: what stands in the place of each block that was replaced, in the end.

    A replacement that comes before a block was put in does not touch it. Chains of replacements are followed by doubling
    links, so the rounds grow with the logarithm of the longest chain; ``seq`` grows along a chain, so there are no circles.
    Each round is written, in files of a share each, and dealt out in shares again, so a task's memory does not follow the
    table. Links that have come to their end stay where they were written.
    """
    links, done = written(linked_edits(replaced, by), "edit-links"), []
    n = shares(links)
    while not (going := links.filter("next IS NOT NULL")).isEmpty():
        done.append(links.filter("next IS NULL"))
        every = reduce(DataFrame.unionByName, done, going)
        ahead = every.select(by, F.col("seq").alias("next"), F.col("new_id").alias("new_ahead"), F.col("next").alias("next_ahead"))
        joined = going.repartition(n, by, "next").join(ahead.repartition(n, by, "next"), [by, "next"], "left")
        links = written(joined.select(by, "seq", "old_id", F.coalesce("new_ahead", "new_id").alias("new_id"), F.col("next_ahead").alias("next")), "edit-links")
    every = reduce(DataFrame.unionByName, done, links)
    return written(every.repartition(n, by, "old_id").groupBy(by, F.col("old_id").alias("block_id")).agg(F.min_by("new_id", "seq").alias("end_id")), "edit-ends")


def final_ids(ids: DataFrame, replaced: DataFrame, by: str = "doc_id") -> DataFrame:
    """``by, block_id, final_id``: what stands in a block's place after all replacements ``by, seq, old_id, new_id``, in order of ``seq``."""
    rows = ids.select(by, "block_id").distinct().join(ends_of(replaced, by), [by, "block_id"], "left")
    return rows.select(by, "block_id", F.coalesce("end_id", "block_id").alias("final_id"))


def replaced_structure(structure: DataFrame, replaced: DataFrame, by: str = "doc_id") -> DataFrame:
    """``structure(by, parent_id, pos, block_id)`` with replaced blocks in the place of the old ones, and parents likewise.

    In a list that has a block twice the first place is the one that is replaced.
    """
    ends = ends_of(replaced, by)
    n = max(shares(structure), shares(ends))
    parents = ends.select(by, F.col("block_id").alias("parent_id"), F.col("end_id").alias("final_parent"))
    first = F.row_number().over(Window.partitionBy(by, "parent_id", "block_id").orderBy("pos")) == 1
    rows = structure.repartition(n, by, "parent_id").withColumn("first", first).join(parents.repartition(n, by, "parent_id"), [by, "parent_id"], "left")
    rows = rows.repartition(n, by, "block_id").join(ends.repartition(n, by, "block_id"), [by, "block_id"], "left")
    block = F.when(F.col("first"), F.coalesce("end_id", "block_id")).otherwise(F.col("block_id"))
    return rows.select(by, F.coalesce("final_parent", "parent_id").alias("parent_id"), "pos", block.alias("block_id"))


def tombstoned(blocks: DataFrame, replaced: DataFrame, by: str = "doc_id") -> DataFrame:
    """All blocks, old and new, with ``removed`` true for those that were replaced; none is dropped."""
    gone = replaced.select(by, F.col("old_id").alias("block_id")).distinct().withColumn("gone", F.lit(True))
    rows = blocks.join(gone, [by, "block_id"], "left")
    return rows.withColumn("removed", F.coalesce("gone", F.lit(False)) | F.coalesce("removed", F.lit(False))).drop("gone")
