"""Writers: stitched documents, append-only logs, replaceable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered_pages(fragments: DataFrame) -> DataFrame:
    """``doc_id, page, md``: a page's anchor, title, subtitle and body as Markdown."""
    line = lambda mark, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(mark), F.col(c), F.lit("\n\n"))).otherwise("")
    return fragments.select("doc_id", "page", F.concat(F.lit("## 第 "), (F.col("page") + 1).cast("string"), F.lit(" 頁\n\n"), line("### ", "title"), line("#### ", "subtitle"), F.coalesce("body", F.lit(""))).alias("md"))


def stitched(pages: DataFrame, title: Column) -> DataFrame:
    """``doc_id, md``: one document of its pages in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda x: x["md"])
    return pages.groupBy("doc_id").agg(F.concat(F.lit("# "), F.first(title), F.lit("\n\n"), F.array_join(ordered, "\n\n---\n\n"), F.lit("\n")).alias("md"))


def append_log(changes: DataFrame, path: str) -> None:
    """A change log grows by a run; headers are in each file."""
    changes.write.mode("append").option("header", True).csv(path)


def save_vectors(vectors: DataFrame, path: str, by: str = "file_key") -> None:
    """Vectors by file: only the files at hand are replaced."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def save_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def triage_log(rows: DataFrame, path: str) -> None:
    """One JSON object per row, appended by a run."""
    rows.write.mode("append").json(path)


def matrix_rows(rows: DataFrame, cells: str = "cells", order: str = "row_no") -> DataFrame:
    """``row_no, cells, blanks``: a matrix's rows without those of blank cells only, and how many blank cells each lacks to the longest.

    A matrix has as many cells as its longest row in each row, so it is made only where all of them are asked for.
    """
    kept = rows.filter(F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    width = kept.agg(F.max(F.size(cells)).alias("_w"))
    own = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    return kept.join(F.broadcast(width)).select(order, own.alias(cells), (F.col("_w") - F.size(cells)).alias("blanks"))


def matrix(rows: DataFrame, cells: str = "cells", order: str = "row_no") -> DataFrame:
    """``row_no, cells``: rows of a matrix padded to the longest, without those of blank cells only."""
    return matrix_rows(rows, cells, order).select(order, F.concat(cells, F.array_repeat(F.lit(""), F.col("blanks"))).alias(cells))


def save_matrix(rows: DataFrame, path: str, cells: str = "cells", order: str = "row_no") -> None:
    """A matrix as CSV files in order, with the byte order mark that spreadsheets look for at the head of the first."""
    table = matrix_rows(rows, cells, order)
    quoted = F.transform(cells, lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    first = table.agg(F.min(order)).first()[0]
    line = F.concat(F.when(F.col(order) == F.lit(first), F.lit("\ufeff")).otherwise(""), F.array_join(quoted, ","), F.repeat(F.lit(","), F.col("blanks")))
    table.orderBy(order).select(line.alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def swapped_in(rows: DataFrame, path: str) -> None:
    """Writes beside ``path`` and renames, so that readers find the old table or the new one, whole.

    The old table goes only after the new one is complete; a failed write leaves it as it was.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, own = (jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".new", path + ".old", path))
    files = own.getFileSystem(conf)
    rows.write.mode("overwrite").parquet(path + ".new")
    files.delete(old, True)
    if files.exists(own):
        files.rename(own, old)
    files.rename(new, own)
    files.delete(old, True)


def audited(before: DataFrame, after: DataFrame, key: str, fields: list[str], run: str) -> DataFrame:
    """``run, key, field, old, new``: what a run would change, to be looked at before anything is written."""
    long = lambda df, value: df.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", value))
    both = long(before, "old").join(long(after, "new"), [key, "field"], "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.lit(run).alias("run"), key, "field", "old", "new")


def ensure_table(rows: DataFrame, path: str, by: list[str], recreate: bool = False) -> bool:
    """Creates a table of points, empty and with the schema of ``rows``, partitioned by the fields that filters use.

    True where it was created; an existing one stays unless ``recreate``. Partitions and Parquet's statistics take the
    part of an index on each field.
    """
    spark = rows.sparkSession
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own) and not recreate:
        return False
    rows.limit(0).write.mode("overwrite").partitionBy(*by).parquet(path)
    return True
