"""Continuous ingestion: a stream of documents becomes chunks that are upserted batch by batch.

The batch operators do the work, so a stream and a batch over the same rows end in the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def latest_states(log: DataFrame, key: str, state: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The latest state of each key within the watermark, from a stream of events."""
    return log.withWatermark(ts, delay).groupBy(key).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))


def windowed_counts(log: DataFrame, ts: str, by: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and value; late ones count until the watermark passes."""
    return log.withWatermark(ts, delay).groupBy(F.window(ts, length), by).agg(F.count("*").alias("n"))


def upsert_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], key: str, order: list[str], table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each micro-batch, transformed, replaces its keys in a Parquet table in ``buckets`` by a hash of the key.

    Of several rows of a key, in a batch or in the table, the newest by ``order`` counts; of equal ones the last by all
    columns, so the result does not depend on how rows arrive. Only buckets that a batch touches are written anew, each
    as ``bucket=b/version=n`` of the batch's number, whole before older versions of it go. A batch that is repeated after
    a failure writes the same versions again. ``current_table`` reads the last version of each bucket.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        delta = transform(batch)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        delta = delta.withColumn("bucket", bucket)
        touched = [r.bucket for r in delta.select("bucket").distinct().collect()]  # ``buckets`` at most
        before = versions_of(spark, table, number)
        every = delta
        if old := [f"{table}/bucket={b}/version={before[b]}" for b in touched if b in before]:
            every = spark.read.parquet(*old).withColumn("bucket", bucket).unionByName(delta)
        newest = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in order), F.desc(F.to_json(F.struct(*delta.columns)))))
        rows = every.withColumn("_n", newest).filter("_n = 1").drop("_n").withColumn("version", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(table)
        files, path = _store(spark, table)
        for b in touched:
            if b in before:
                files.delete(path(f"{table}/bucket={b}/version={before[b]}"), True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _store(spark: SparkSession, table: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions_of(spark: SparkSession, table: str, below: int | None = None) -> dict[int, int]:
    """The last version of each bucket of a table, of those under ``below``."""
    files, path = _store(spark, table)
    out: dict[int, int] = {}
    for found in files.globStatus(path(f"{table}/bucket=*/version=*")) or []:
        b, v = (int(part.partition("=")[2]) for part in found.getPath().toString().split("/")[-2:])
        if below is None or v < below:
            out[b] = max(v, out.get(b, -1))
    return out


def current_table(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table that ``upsert_stream`` keeps."""
    return spark.read.parquet(*(f"{table}/bucket={b}/version={v}" for b, v in sorted(versions_of(spark, table).items())))
