"""Token ids in a content-addressed store: chunks cut by a rolling hash, document recipes, Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import documents, removed, row_ids, shared_dir
from paperloom.llm.tokens import encoder, end_bytes, vocabulary

END = 2
#: Ids under the rolling hash; a chunk ends where the hash's low bits are all 1, between least and most ids.
WINDOW, CUT_BITS, LEAST_IDS, MOST_IDS = 16, 8, 64, 4096
#: Digests of chunks that a task remembers having sent.
REMEMBERED = 200_000
TEXTS = 200
BATCH_BYTES = 8 << 20
#: Documents under one inner node of a manifest.
NODE_DOCS = 1024
CHUNK, RECIPE = 0, 1
RECIPES = "part int, pos long, uid long, doc_id {id}, start long, n_tokens long, sizes binary, leaves binary, root string"


def cut_places(streams: list[np.ndarray]) -> list[list[int]]:
    """For each stream of ids the places after which a chunk may end.

    A place's hash covers its id and the ``WINDOW - 1`` before it in the same stream, so equal passages have equal
    places. All streams are hashed in one go, with room between them where nothing adds to the hash.
    """
    if not streams:
        return []
    sizes = np.array([len(s) for s in streams])
    starts = np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1]))
    own = np.zeros(int((sizes + WINDOW).sum()), np.uint32)
    for start, ids in zip(starts.tolist(), streams, strict=True):
        own[start : start + len(ids)] = ids + np.uint32(1)
    own *= np.uint32(0x9E3779B1)
    own ^= own >> np.uint32(15)
    out = own.copy()
    for k in range(1, WINDOW):
        out[k:] += own[:-k] << np.uint32(k)
    low = np.uint32((1 << CUT_BITS) - 1)
    places = np.flatnonzero(out >> np.uint32(WINDOW) & low == low)
    cut = np.searchsorted(places, np.stack([starts, starts + sizes]))
    return [(places[a:b] - start + 1).tolist() for a, b, start in zip(cut[0], cut[1], starts, strict=True)]


def chunk_ends(size: int, places: list[int]) -> list[int]:
    """Where the chunks of a stream end: at a place between ``LEAST_IDS`` and ``MOST_IDS`` from the start, and at its end."""
    ends, start = [], 0
    for at in places:
        while at - start > MOST_IDS:
            start += MOST_IDS
            ends.append(start)
        if at - start >= LEAST_IDS:
            ends.append(at)
            start = at
    while size - start > MOST_IDS:
        start += MOST_IDS
        ends.append(start)
    return [*ends, size] if start < size else ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root over digests: pairs are hashed together level by level, an odd one goes up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[k] + level[k + 1]).digest() for k in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def stored_ids(ids: bytes) -> bytes:
    """A chunk in the file format: the bytes of each id, 2 where all ids fit, else 4, after a byte that says so."""
    own = np.frombuffer(ids, "<u4")
    return b"\x02" + own.astype("<u2").tobytes() if not len(own) or own.max() < 1 << 16 else b"\x04" + ids


def loaded_ids(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"\x04" else np.frombuffer(data, "<u2", -1, 1).astype("<u4").tobytes()


class Store:
    """Three tables in a folder: ``chunks``, ``recipes`` in ascending order of doc_id, and the ``manifest``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint") -> None:
        self.spark, self.path, self.id_type = spark, path, id_type

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("place binary, data binary").parquet(f"{self.path}/chunks").withColumnRenamed("place", "digest")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(RECIPES.format(id=self.id_type)).parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("part int, n_docs long, n_tokens long, root string").parquet(f"{self.path}/manifest")


def cut_documents(source: DataFrame, tokenizer_path: str, end_id: int, id_type: str, plain: bool) -> DataFrame:
    """Chunks and recipes as rows of one table, ``kind, place, uid, doc_id, sizes, data``; a task sends a chunk once."""
    end = end_bytes(end_id)
    names = ["kind", "place", "uid", "doc_id", "sizes", "data"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent = encoder(tokenizer_path, plain), set()
        for part in parts:
            uids, doc_ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
            for first in range(0, len(texts), TEXTS):
                rows = []
                streams = [ids + end for ids in own.encode([t or "" for t in texts[first : first + TEXTS]])]
                for k, (ids, places) in enumerate(zip(streams, cut_places([np.frombuffer(x, "<u4") for x in streams]), strict=True), first):
                    at, leaves, sizes = 0, [], []
                    for stop in chunk_ends(len(ids) // 4, places):
                        chunk = ids[4 * at : 4 * stop]
                        digest = hashlib.sha256(chunk).digest()
                        leaves.append(digest)
                        sizes.append(stop - at)
                        at = stop
                        if digest not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(digest)
                            rows.append((CHUNK, digest, None, None, None, stored_ids(chunk)))
                    place = uids[k].to_bytes(8, "big")
                    rows.append((RECIPE, place, uids[k], doc_ids[k], np.array(sizes, "<u4").tobytes(), b"".join(leaves)))
                columns = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.binary(), pa.int64(), part.schema.field(1).type, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return source.mapInArrow(run, f"kind int, place binary, uid long, doc_id {id_type}, sizes binary, data binary")


def once(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without the repeats of a chunk."""
    last = None
    for part in parts:
        keep = []
        for kind, place in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            keep.append(kind == RECIPE or place != last)
            last = place if kind == CHUNK else last
        yield part.filter(pa.array(keep, pa.bool_()))


def recipe_rows(id_type: str):
    """Recipes in order, each with its place and start in its part and its Merkle root."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = start = 0
        for part in parts:
            sizes, leaves = part.column("sizes").to_pylist(), part.column("data").to_pylist()
            totals = [int(np.frombuffer(s, "<u4").sum()) for s in sizes]
            roots = [merkle_root([own[k : k + 32] for k in range(0, len(own), 32)]).hex() for own in leaves]
            starts = start + np.concatenate(([0], np.cumsum(totals)[:-1])).astype(np.int64) if totals else np.empty(0, np.int64)
            arrays = [part.column("part"), pa.array(range(pos, pos + len(totals)), pa.int64()), part.column("uid"), part.column("doc_id"), pa.array(starts), pa.array(totals, pa.int64()), part.column("sizes"), part.column("data"), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RECIPES.split(", ")])
            pos, start = pos + len(totals), start + sum(totals)

    return run


def node(column: str):
    """The digest of a run of roots, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column]), ""), 256)


def manifest_of(recipes: DataFrame) -> DataFrame:
    """A row per part of the recipes: its documents, its ids, and the root over its documents' roots."""
    inner = recipes.select("part", F.floor(F.col("pos") / NODE_DOCS).alias("run"), "pos", "n_tokens", "root").groupBy("part", "run").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), node("root").alias("root"))
    return inner.withColumnRenamed("run", "pos").groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), node("root").alias("root"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END, plain: bool = False) -> Store:
    """Encodes every whole text, appends the end id, and writes the ids as a store.

    Texts are encoded once. Each stream of ids is cut where a rolling hash says so, and chunks meet by their SHA-256 in
    one shuffle: each is stored once. A chunk that very many documents share leaves each scan task once, so its key has
    as many rows as there are tasks at most. Recipes (digests and sizes of a document's chunks) are written in ascending
    order of doc_id, with the Merkle root over the digests; the manifest has a root over each part's documents.

    Names of special tokens in a text are those tokens, as the tokenizers have it, or ordinary text with ``plain``.
    A null text is the end id alone. A null id sorts first; rows with equal ids follow each other in the order of the
    table. An empty table gives an empty store. Other columns are not read.
    """
    spark, id_type = docs.sparkSession, docs.schema[key].dataType.simpleString()
    store = Store(spark, path, id_type)
    source = row_ids(docs, [key, text]).toDF("uid", "doc_id", "text")
    mixed = cut_documents(source, tokenizer_path, end_id, id_type, plain)
    sorted_rows = mixed.repartition("place").sortWithinPartitions("kind", "place")
    sorted_rows.mapInArrow(once, mixed.schema).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/draft")
    draft = spark.read.schema(mixed.schema).parquet(f"{path}/draft")
    recipes = draft.filter(F.col("kind") == RECIPE).select("uid", "doc_id", "sizes", "data").repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    recipes.select(F.spark_partition_id().alias("part"), "uid", "doc_id", "sizes", "data").mapInArrow(recipe_rows(id_type), RECIPES.format(id=id_type)).write.parquet(f"{path}/recipes")
    manifest_of(store.recipes()).write.parquet(f"{path}/manifest")
    moved(spark, f"{path}/draft/kind={CHUNK}", f"{path}/chunks", "place binary, uid long, doc_id string, sizes binary, data binary")
    removed(spark, f"{path}/draft")
    return store


def moved(spark: SparkSession, source: str, target: str, empty: str) -> None:
    """Renames a folder of the shared file system; where there is none, the target becomes an empty table."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = Path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(Path(source)):
        spark.createDataFrame([], empty).write.parquet(target)
    elif not files.rename(Path(source), Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def chunk_facts(store: Store) -> DataFrame:
    """``digest, n, crc``: every chunk read from its file, decoded, and held against its digest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests = part.column(0).to_pylist()
            ids = [loaded_ids(d) for d in part.column(1).to_pylist()]
            for digest, own in zip(digests, ids, strict=True):
                if hashlib.sha256(own).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["digest", "n", "crc"])

    return store.chunks().mapInArrow(run, "digest binary, n long, crc long")


def crc_operators() -> np.ndarray:
    """For each k, what 2 ** k zero bytes do to a crc32: the images of its 32 bits."""
    one = np.array([(1 << (b - 1)) if b else 0xEDB88320 for b in range(32)], np.uint64)
    bit = one
    for _ in range(3):  # 8 zero bits
        bit = applied(bit, bit)
    out = [bit]
    for _ in range(47):
        out.append(applied(out[-1], out[-1]))
    return np.array(out)


def applied(operator: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crcs), np.uint64)
    for b in range(32):
        out ^= np.where(crcs >> np.uint64(b) & np.uint64(1) > 0, operator[b], np.uint64(0))
    return out


def byte_tables() -> list[list[list[int]]]:
    """The operators as four tables of 256 each, one for each byte of a crc32."""
    values = np.arange(256, dtype=np.uint64)
    return [[applied(operator, values << np.uint64(8 * byte)).tolist() for byte in range(4)] for operator in crc_operators()]


ZERO_BYTES = byte_tables()


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """The crc32 of contents one after another, from their own and their bytes."""
    total = 0
    for crc, size in zip(crcs, sizes, strict=True):
        k = 0
        while size and total:
            if size & 1:
                a, b, c, d = ZERO_BYTES[k]
                total = a[total & 255] ^ b[total >> 8 & 255] ^ c[total >> 16 & 255] ^ d[total >> 24]
            size >>= 1
            k += 1
        total ^= crc
    return total


def leaves(recipes: DataFrame) -> DataFrame:
    """``part, pos, seq, digest, size``: a row for each chunk of each document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = [np.frombuffer(s, "<u4") for s in part.column("sizes").to_pylist()]
            counts = [len(s) for s in sizes]
            own = [b[k : k + 32] for b in part.column("leaves").to_pylist() for k in range(0, len(b), 32)]
            again = pa.array(np.repeat(np.arange(part.num_rows), counts))
            seq = np.concatenate([np.arange(n) for n in counts]) if counts else np.empty(0)
            yield pa.RecordBatch.from_arrays([part.column("part").take(again), part.column("pos").take(again), pa.array(seq.astype(np.int32)), pa.array(own, pa.binary()), pa.array(np.concatenate(sizes).astype(np.int64) if sizes else [], pa.int64())], names=["part", "pos", "seq", "digest", "size"])

    return recipes.select("part", "pos", "sizes", "leaves").mapInArrow(run, "part int, pos long, seq int, digest binary, size long")


def part_starts(store: Store) -> DataFrame:
    """``part, before``: the ids in the parts before; as many rows as parts."""
    ahead = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return store.manifest().select("part", F.coalesce(ahead, F.lit(0)).alias("before"))


def verified_recipes(store: Store) -> DataFrame:
    """The recipes, with an error where one's root or the root of its part is not the manifest's."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for own, root in zip(part.column("leaves").to_pylist(), part.column("root").to_pylist(), strict=True):
                if merkle_root([own[k : k + 32] for k in range(0, len(own), 32)]).hex() != root:
                    raise ValueError(f"a recipe does not have the root {root}")
            yield part

    recipes = store.recipes()
    found = manifest_of(recipes).select("part", F.col("root").alias("found"))
    bad = store.manifest().join(found, "part", "full_outer").filter(~F.col("root").eqNullSafe(F.col("found")))
    if not bad.isEmpty():
        raise ValueError(f"the recipes of part {bad.first().part} do not have the manifest's root")
    return recipes.mapInArrow(run, recipes.schema)


def read_index(store: Store) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    Every stored chunk is read, decoded and held against its digest; every recipe is held against its Merkle root and
    the manifest. A document's ids are its chunks one after another, so its length and crc32 follow from theirs, without
    moving the ids: only digests, sizes and checksums are shuffled. ``read_documents`` gives the ids themselves.
    """
    recipes = verified_recipes(store)
    facts = leaves(recipes).join(chunk_facts(store), "digest", "left")
    grouped = facts.groupBy("part", "pos").agg(F.array_sort(F.collect_list(F.struct("seq", "size", "n", "crc"))).alias("chunks"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for chunks in part.column(2).to_pylist():
                if any(c["n"] != c["size"] for c in chunks):
                    raise ValueError("a chunk is missing or has another size than its recipe says")
                rows.append((joined_crc([c["crc"] for c in chunks], [4 * c["n"] for c in chunks]), sum(c["n"] for c in chunks)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["part", "pos", "ids_crc32", "read"])

    sums = grouped.mapInArrow(run, "part int, pos long, ids_crc32 long, read long")
    own = store.recipes().select("part", "pos", "doc_id", "start", "n_tokens").join(sums, ["part", "pos"])
    placed = own.join(F.broadcast(part_starts(store)), "part")
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("read").alias("n_tokens"), "ids_crc32")


def read_documents(store: Store) -> DataFrame:
    """``doc_id, start, ids``: the whole id streams, rebuilt from the chunks."""
    facts = leaves(verified_recipes(store)).join(store.chunks(), "digest")
    grouped = facts.groupBy("part", "pos").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("chunks"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = [np.frombuffer(b"".join(loaded_ids(c["data"]) for c in chunks), "<u4").astype(np.int64) for chunks in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["part", "pos", "ids"])

    rebuilt = grouped.mapInArrow(run, "part int, pos long, ids array<long>")
    own = store.recipes().select("part", "pos", "doc_id", "start").join(rebuilt, ["part", "pos"])
    return own.join(F.broadcast(part_starts(store)), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_store(documents(spark, sf_dir), shared_dir(spark, "token-store"), vocabulary("word_bpe_49k.json"))
    return read_index(store)
