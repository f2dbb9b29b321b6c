"""Tables that belong together by position: results that come back without keys, in the order in which they were asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.scratch import written


def numbered(rows: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """The rows with their number from 0 in an order; of equal ones any comes first.

    They are dealt out by ranges and sorted within, and written, so that each task has a run of the order that stays as it
    is; the counts of the tasks before give each run its first number. No task sees more than its run, and what the window
    looks over has one row a task.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    at, task = "_at", "_task"
    # The upper bits of this number are the task, the lower ones the row's place in it.
    kept = written(sorted_rows.withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(task, F.shiftright(at, 33))
    counts = kept.groupBy(task).agg(F.count("*").alias("_n"))
    before = counts.select(task, F.coalesce(F.sum("_n").over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), task).withColumn(name, F.col("_before") + place).drop(at, task, "_before")


def zipped(asked: DataFrame, order: list[Column | str], answers: DataFrame, answer_order: list[Column | str]) -> DataFrame:
    """Each row of ``asked`` with the answer at its place; where one side is longer, the other's columns are null."""
    left, right = numbered(asked, *order), numbered(answers, *answer_order)
    return left.join(right, "ordinal", "full_outer").drop("ordinal")


def ordinals(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The rows with their place from 0 in their group, for groups as small as a page."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def zipped_in_groups(asked: DataFrame, answers: DataFrame, by: list[str], order: list[Column | str], answer_order: list[Column | str]) -> DataFrame:
    """As ``zipped``, place by place within each group: the lines of a page with what was told of them in order."""
    return ordinals(asked, by, *order).join(ordinals(answers, by, *answer_order), [*by, "ordinal"], "full_outer").drop("ordinal")


def gathered_per_page(tables: DataFrame, answers: DataFrame, answer_order: list[Column | str], page: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Each table with the answer for its page, where each page that has tables was asked for once, in order of ``page``.

    The answers ``answers`` come without keys, in ``answer_order``.
    """
    pages = tables.select(*page).distinct()
    return tables.join(zipped(pages, list(page), answers, answer_order), list(page), "left")


def pages_to_recognise(pages: DataFrame, labels: DataFrame, label_order: list[Column | str], share: float = 0.5, bad: str = "bad") -> DataFrame:
    """``doc_id, n_pages, n_bad, recognise``: documents of whose pages at least ``share`` are labelled ``bad``.

    ``pages(doc_id, page)`` were given to a labeller in this order, and ``labels(label)`` came back in ``label_order``; a page
    without a label is not bad.
    """
    told = zipped(pages.select("doc_id", "page"), ["doc_id", "page"], labels, label_order).filter("doc_id IS NOT NULL")
    counts = told.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("label") == bad).alias("n_bad"))
    return counts.withColumn("recognise", F.col("n_bad") >= F.col("n_pages") * share)
