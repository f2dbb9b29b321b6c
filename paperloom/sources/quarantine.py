"""Rows and files that fail as data: errors in a column, a table of what failed, and its next try."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.sources.scratch import written

#: Characters of an error that are kept.
SHOWN = 500


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:SHOWN]


def tried(rows: DataFrame, made: Callable[[dict], dict], result: str) -> DataFrame:
    """All rows with the columns ``result`` that ``made`` gives for each, and ``error``: null, or what it raised.

    A row that fails has nulls for results and takes no other row with it. The function gets a row as a dictionary, one batch
    of rows is held at a time, and ``result`` is a schema like ``"route string, score double"``.
    """
    fields = rows.sparkSession.createDataFrame([], result).schema
    clash = set(rows.columns) & {*fields.names, "error"}
    if clash:
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    whole = StructType([*rows.schema, *fields, StructField("error", StringType())])
    arrow = to_arrow_schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: dict[str, list] = {name: [] for name in arrow.names}
            errors: list[str | None] = []
            for row in part.to_pylist():
                try:
                    got = made(row)
                    values = [pa.scalar(got.get(f.name), f.type) for f in arrow]  # what does not fit its type is an error too
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever a row raises is its result
                    values = [pa.scalar(None, f.type) for f in arrow]
                    errors.append(said(error))
                for name, value in zip(arrow.names, values, strict=True):
                    out[name].append(value.as_py())
            columns = [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array(errors, pa.string())], names=whole.names)

    return rows.mapInArrow(run, whole)


def routed(pages: DataFrame, route: Callable[[dict], str], fallback: str = "fast") -> DataFrame:
    """Pages with ``route``, ``route_fallback`` and ``error``: a page whose route cannot be told takes the fallback, with a mark."""
    rows = tried(pages, lambda row: {"route": route(row)}, "route string")
    return rows.withColumn("route_fallback", F.col("error").isNotNull()).withColumn("route", F.coalesce("route", F.lit(fallback)))


def quarantined(rows: DataFrame, key: str, before: DataFrame | None = None) -> DataFrame:
    """``key, error, tries``: the rows that failed, with how often they did, going on from the table of the run before.

    What has succeeded now is no longer in it; what was not tried stays as it was.
    """
    now = rows.groupBy(key).agg(F.max("error").alias("error"))
    if before is None:
        return now.filter("error IS NOT NULL").withColumn("tries", F.lit(1))
    both = before.select(key, F.col("error").alias("old"), "tries").join(now.withColumn("now", F.lit(True)), key, "full_outer")
    tries = F.coalesce("tries", F.lit(0)) + F.when(F.col("error").isNotNull(), 1).otherwise(0)
    kept = both.select(key, F.when(F.col("now"), F.col("error")).otherwise(F.col("old")).alias("error"), tries.alias("tries"))
    return kept.filter("error IS NOT NULL")


def to_try(rows: DataFrame, key: str, done: DataFrame, quarantine: DataFrame, most: int = 3) -> DataFrame:
    """The rows of the next run: those that are neither done nor given up after ``most`` tries."""
    given_up = quarantine.filter(F.col("tries") >= most).select(key)
    return rows.join(done.select(key), key, "left_anti").join(given_up, key, "left_anti")


def local_entry(scheme: str, entry: os.DirEntry) -> tuple:
    """An entry of a mounted folder; a link to nothing is one whose size cannot be read."""
    try:
        is_dir = entry.is_dir()
        return scheme + entry.path, is_dir, None if is_dir else entry.stat().st_size, None
    except OSError as error:
        return scheme + entry.path, False, None, said(error)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, is_dir, size, error`` of everything under a folder; a folder or file that cannot be read is a row with its error.

    Folders are listed by tasks, level by level, so no folder's entries pass through the driver; each level is written to
    the shared folder and only the number of its folders comes back.
    """

    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                files, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                scheme = path[: len(path) - len(place)] if path.endswith(place) else ""
                rows: list[tuple] = []
                try:
                    if isinstance(files, pafs.LocalFileSystem):
                        rows += [local_entry(scheme, entry) for entry in os.scandir(place)]
                    else:
                        rows += [(scheme + info.path, info.type == pafs.FileType.Directory, info.size, None) for info in files.get_file_info(pafs.FileSelector(place))]
                except OSError as error:
                    rows.append((path, True, None, said(error)))
                paths, dirs, sizes, errors = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(dirs, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["path", "is_dir", "size", "error"])

    schema = "path string, is_dir boolean, size long, error string"
    level, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        own = written(level.mapInArrow(entries, schema), "listing")
        levels.append(own)
        level = own.filter("is_dir AND error IS NULL").select("path")
        n = level.count()
        if not n:
            break
        level = level.repartition(min(n, spark.sparkContext.defaultParallelism * 4))
    out = levels[0]
    for own in levels[1:]:
        out = out.unionByName(own)
    return out


def folder_sizes(entries: DataFrame) -> DataFrame:
    """``ext, n_files, bytes, n_errors`` of a listing; what failed is counted and takes no part in the sizes."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return entries.filter("NOT is_dir OR error IS NOT NULL").groupBy(ext.alias("ext")).agg(F.count_if(F.col("error").isNull()).alias("n_files"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
