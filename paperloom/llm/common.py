"""Helpers shared by the training-data operators: shared folders, row numbers, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``[\x20\x09-\x0D]`` matches; ``bytes.split()`` cuts at exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and turns everything outside ``[0-9a-z]`` and non-ASCII into a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only a local session may do without that setting: there a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/paperloom/{name}-{uuid.uuid4().hex}"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it, on whichever machine this runs."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that the cluster's configuration gives it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, and lost executors cost only a read."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system that is no longer read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables in the shared folder that an operator needs only until its result is written.

    As a context manager it removes what is left at the end, also after an error; ``drop`` removes some earlier.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, []

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """As ``written``, for this operator's own use; ``options`` are the writer's."""
        path = shared_dir(self.spark, name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, out))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path, own in list(self.tables):
            if any(own is t for t in tables):
                removed(self.spark, path)
                self.tables.remove((path, own))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*(own for _, own in self.tables))


def bounded(spark: SparkSession) -> None:
    """Hands rows to Python in batches of at most 8 MB, so that a worker's memory does not follow the length of texts.

    The settings are the session's, and they stay, since Spark reads them when a plan runs; lower ones are left as they are.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, 2001):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Nodes of a plan that give the same rows in the same partitions whenever they run.
PLAIN = {"Project", "Filter", "Relation", "LogicalRDD", "LocalRelation", "Range", "SubqueryAlias", "Union", "Generate"}


def stable(df: DataFrame) -> DataFrame:
    """``df`` as something whose rows can be numbered more than once: itself if it is a scan, else written first.

    A plan with an exchange, a join or Python in it may deal its rows out anew each time it runs; joining decisions back to
    rows by their number would then keep the wrong ones.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for m in (re.match(r"[\s:+\-]*(\w+)", line) for line in plan.splitlines() if line.strip()) if m}
    return df if nodes <= PLAIN else written(df, "input")


def row_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with ``uid``, a number of the row: ids may be null or repeat, row numbers do not.

    Where rows are numbered more than once, ``df`` has to be ``stable``.
    """
    bounded(df.sparkSession)
    return df.select(F.monotonically_increasing_id().alias("uid"), *(F.col(f"`{c}`") for c in columns))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
