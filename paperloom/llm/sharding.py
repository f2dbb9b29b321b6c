"""Sharding by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import documents, removed, shared_dir, written

SLOTS = 4096
SHARDS = 8
MAP = "version int, slot int, shard int, bytes long, n_rows long"


def slot_of(key: str, text: str, slots: int = SLOTS) -> Column:
    """A record's virtual slot: a hash of its id, or of its text where it has no id."""
    return F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(text)), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal runs of slots."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("slot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("n_rows"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """``slot, bytes, n_rows`` of ``records(slot, size)``, summed up before the shuffle; as many rows as slots at most."""
    return records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def measured(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """The map with the bytes and rows that its slots hold now."""
    left = slot_map.select("version", "slot", "shard").join(F.broadcast(sizes), "slot", "left")
    return left.select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def rebalanced(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version: slots leave shards that hold more than their part of the bytes.

    A fold over the slots, largest first: a slot stays while its shard has room under the mean, else it goes to the shard
    that holds least. The fold is one expression over one row with a slot per element; the map's size is fixed.
    """
    one = slot_map.agg(F.max("version").alias("version"), F.sort_array(F.collect_list(F.struct("bytes", "slot", "shard", "n_rows")), asc=False).alias("all"), F.ceil(F.sum("bytes") / shards).alias("mean"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def step(state: Column, s: Column) -> Column:
        loads = state["loads"]
        least = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        to = F.when(F.get(loads, s["shard"]) + s["bytes"] <= F.col("mean"), s["shard"]).otherwise(least)
        return F.struct(F.transform(loads, lambda x, i: x + F.when(i == to, s["bytes"]).otherwise(F.lit(0).cast("long"))).alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))

    folded = one.select("version", "all", F.aggregate("all", start, step)["to"].alias("to"))
    moved = folded.select((F.col("version") + 1).alias("version"), F.explode(F.arrays_zip("all", "to")).alias("s"))
    return moved.select("version", F.col("s.all.slot").alias("slot"), F.col("s.to").alias("shard"), F.col("s.all.bytes").alias("bytes"), F.col("s.all.n_rows").alias("n_rows"))


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard: each old shard gives it the same part of its slots, no others move."""
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("slot")))
    own = F.count("*").over(Window.partitionBy("shard"))
    return slot_map.select((F.col("version") + 1).alias("version"), "slot", F.when(place <= F.floor(own / (shards + 1)), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n_rows")


class SlotMaps:
    """The versions of a map in a folder of the shared store; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def latest(self) -> int:
        """The number of the last version, 0 where none was stored yet."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return 0
        return self.spark.read.schema(MAP).parquet(self.path).agg(F.max("version")).first()[0] or 0

    def store(self, slot_map: DataFrame) -> DataFrame:
        """Writes the version after the last one and returns it as stored; any other version is refused."""
        versions = [r.version for r in slot_map.select("version").distinct().limit(2).collect()]
        if versions != [self.latest() + 1]:
            raise ValueError(f"version {self.latest() + 1} is next, not {versions}")
        slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(self.path)
        return self.load(versions[0])

    def load(self, version: int | None = None) -> DataFrame:
        every = self.spark.read.schema(MAP).parquet(self.path)
        version = self.latest() if version is None else version
        return every.filter(F.col("version") == version).select(*(c.split()[0] for c in MAP.split(", ")))

    def drop(self) -> None:
        removed(self.spark, self.path)


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, virtual_slot, map_version, shard, slot``.

    Records hash into ``slots`` virtual slots. The bytes of each slot are summed up and measured against the last stored
    slot map (a new one where ``maps`` has none, which is stored as version 1); its rebalanced version, stored after it,
    sends the slots to ``shards`` of near equal size. So a second table, or the same after it has grown, moves only slots
    of shards that hold too much. ``slot`` is the row's place in its shard, gapless from 0: the rows of a shard in
    earlier scan tasks, plus those before it in its own. Nothing but narrow rows is shuffled, and no task gets a whole
    shard or slot.

    ``size`` is the text's UTF-8 bytes plus 1, null as empty; a null id hashes by the text. Repeated rows count one by
    one. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    maps = maps or SlotMaps(spark, shared_dir(spark, "slot-map"))
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = written(source.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), slot_of("doc_id", "text", slots).alias("virtual_slot"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("uid")), "sharded")
    sizes = slot_sizes(rows.withColumnRenamed("virtual_slot", "slot"))
    last = maps.load() if maps.latest() else maps.store(measured(initial_map(spark, shards, slots), sizes))
    if last.count() != slots:
        raise ValueError(f"the stored map has {last.count()} slots, not {slots}")
    last = maps.store(rebalanced(measured(last, sizes), shards))
    placed = rows.join(F.broadcast(last.select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))), "virtual_slot")
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("task", "shard").agg(F.count("*").alias("n")).select("task", "shard", F.coalesce(ahead, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("task", "shard").orderBy("uid")) - 1
    return placed.withColumn("place", place).join(offsets, ["task", "shard"]).select("doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("place") + F.col("before")).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
