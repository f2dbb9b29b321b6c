"""Benchmark decontamination with a broadcast set of normalised n-grams."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, as_bytes, bounded, documents, fresh, plain_words, row_ids, stable, written

#: Words of a window.
WINDOW = 10
#: UTF-8 bytes of benchmark text that one broadcast set is made from; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Words whose windows are hashed at once.
CHUNK_WORDS = 1 << 20
RAW_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


class WindowSet:
    """The distinct windows of some benchmark items, by length: sorted hashes, their words for verification, their items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(text)]
            if words:
                length = min(window, len(words))
                for at in range(len(words) - length + 1):
                    windows.setdefault(length, {}).setdefault(tuple(words[at : at + length]), set()).add(k)
        self.by_length = []
        for length, found in sorted(windows.items()):
            words = np.array(list(found), np.int64).reshape(len(found), length)
            for multiplier in MULTIPLIERS:  # until no two windows share a hash
                hashes = rolling(words, multiplier)
                if len(np.unique(hashes)) == len(hashes):
                    break
            else:
                raise ValueError("windows share hashes under every multiplier")
            by_hash = np.argsort(hashes)
            self.by_length.append((length, multiplier, hashes[by_hash], words[by_hash], [sorted(list(found.values())[k]) for k in by_hash]))

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[list[int]]]]:
        """``words`` are vocabulary numbers, -1 for others: starts of verified windows, their length and their items."""
        for length, multiplier, hashes, own, items in self.by_length:
            known = np.concatenate(([0], np.cumsum(words < 0)))
            starts = np.flatnonzero(known[length:] == known[:-length])
            if not len(starts):
                continue
            found = rolling(np.stack([words[starts + k] for k in range(length)], axis=1), multiplier)
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = hashes[at] == found
            starts, at = starts[same], at[same]
            same = (own[at] == words[starts[:, None] + np.arange(length)]).all(axis=1)
            yield starts[same], length, [items[k] for k in at[same]]


def rolling(windows: np.ndarray, multiplier: int) -> np.ndarray:
    out = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        out = out * np.uint64(multiplier) + (windows[:, k].astype(np.uint64) + np.uint64(1))
        out ^= out >> np.uint64(29)
    return out


def scanned(texts: list[bytes], windows: WindowSet) -> list[tuple[int, np.ndarray, list[int]]]:
    """For each text: its number of words, the numbers of its hit words, and its items' numbers."""
    out: list = [None] * len(texts)
    lookup, held, spans, size = windows.vocabulary.get, [], [], 0

    def flush() -> None:
        line = np.concatenate([*held, [-1]]) if held else np.full(1, -1)
        marks, owner = np.zeros(len(line) + 1, np.int32), np.repeat(np.arange(len(spans)), [s[2] + 1 for s in spans])
        items: list[set[int]] = [set() for _ in spans]
        for starts, length, found in windows.hits(line):
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + length, -1)
            for doc, its in zip(owner[starts].tolist(), found, strict=True):
                items[doc].update(its)
        covered = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        for (k, start, n), own in zip(spans, items, strict=True):
            a, b = np.searchsorted(covered, (start, start + n))
            out[k] = (n, covered[a:b] - start, sorted(own))

    for k, text in enumerate(texts):
        words = plain_words(text)
        spans.append((k, size, len(words)))
        held += [np.fromiter((lookup(w, -1) for w in words), np.int64, len(words)), np.array([-1])]
        size += len(words) + 1
        if size >= CHUNK_WORDS:
            flush()
            held, spans, size = [], [], 0
    if spans:
        flush()
    return out


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; from the first to the last word of a run of hits everything goes."""
    spans = [m.span() for m in RAW_WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    out, at = [], 0
    for run in runs:
        out.append(text[at : spans[run[0]][0]])
        at = spans[run[-1]][1]
    return b"".join([*out, text[at:]])


def benchmark_blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int, held: Scratch) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct items, fetched a block at a time: a block ends with the item that fills ``block_bytes``."""
    items = held.written(benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").distinct(), "benchmark")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-2 * total // block_bytes) or 1))
    block, size = [], 0
    for k in range(-(-2 * total // block_bytes) or 1):  # about half a block each
        for r in items.filter(dealt == k).toLocalIterator():
            block.append((r.item_id, r.text.encode()))
            size += len(block[-1][1])
            if size >= block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``uid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    The windows of the benchmark (``window`` consecutive words; all words of a shorter item) are one broadcast set of
    hashes; every document is scanned once, and each hash that hits is verified word by word. The set is made from
    about ``block_bytes`` of benchmark text: a larger benchmark is taken block by block, each with a scan of its own, whose
    hit words are united per document. The result does not depend on ``block_bytes``.

    Null texts have no words, and neither do empty ones; very long ones are scanned whole. An item without words or with
    a null text has no window; a null item id counts as ''. Items with the same id count once, whatever their texts, and
    so do repeated items. Ids of documents may be null or repeat. Empty tables give no rows or no hits. Other columns are
    not read.
    """
    spark, source = docs.sparkSession, row_ids(stable(docs), [key, text]).toDF("uid", "doc_id", "text")
    id_type = docs.schema[key].dataType.simpleString()
    with Scratch(spark) as held:
        blocks = benchmark_blocks(benchmark, item_key, item_text, block_bytes, held)
        first, second = next(blocks, []), next(blocks, None)
        if second is None:
            sent = spark.sparkContext.broadcast(WindowSet(first, window))

            def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                windows = sent.value
                for part in parts:
                    rows = [(n, len(hit), *items_digest({windows.items[k] for k in items})) for n, hit, items in scanned(as_bytes(part.column(2)), windows)]
                    n, hit, count, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["uid", "doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

            found = source.mapInArrow(run, f"uid long, doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string")
        else:
            one = united(hits_by_block(source, itertools.chain([first, second], blocks), window, id_type, held, every=True))
            joined = F.array_join("items", ",")
            found = written(one.select("uid", "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256")), "contamination")
        return found.withColumn("contaminated", F.col("n_hit") > 0)


def hits_by_block(source: DataFrame, blocks: Iterable[list[tuple[str, bytes]]], window: int, id_type: str, held: Scratch, every: bool) -> DataFrame:
    """``uid, doc_id, n_words, hit, items`` of documents that a block hits, and of ``every`` document for the first block.

    Each block's hits are written before the next block is fetched, so the driver and the workers have one at a time.
    """
    found = None
    for k, block in enumerate(blocks):
        sent = source.sparkSession.sparkContext.broadcast(WindowSet(block, window))
        part = held.written(hit_rows(source, sent, id_type, every and not k), "benchmark-hits")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def united(hits: DataFrame) -> DataFrame:
    """One row per document of ``hits``, with all hit words and items of all blocks, sorted."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return hits.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), every("hit"), every("items"))


def hit_rows(source: DataFrame, sent, id_type: str, every: bool) -> DataFrame:
    """``uid, doc_id, n_words, hit, items`` for one block of the benchmark."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for part in parts:
            rows = [(n, hit.tolist(), sorted({windows.items[k] for k in items})) for n, hit, items in scanned(as_bytes(part.column(2)), windows)]
            n, hit, items = zip(*rows, strict=True) if rows else ((), (), ())
            out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["uid", "doc_id", "n_words", "hit", "items"])
            yield out if every else out.filter(pa.array([bool(h) for h in hit], pa.bool_()))

    return source.mapInArrow(run, f"uid long, doc_id {id_type}, n_words long, hit array<long>, items array<string>")


def items_digest(items: set[str]) -> tuple[int, str]:
    return len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminated(docs: DataFrame, benchmark: DataFrame, how: str = "documents", key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without contaminated documents (``how='documents'``) or without the spans hit (``'spans'``).

    All columns stay, and of spans only the text column differs. Hits are looked for in the original texts, and those of
    all blocks are cut together, so the result does not depend on ``block_bytes``. Null and empty texts have no hits and
    stay as they are; ids may be null or repeat and repeated rows are judged one by one; names of other columns may clash
    with any used here. An empty benchmark leaves everything, an empty table stays empty.
    """
    if how not in ("documents", "spans"):
        raise ValueError(f"how is 'documents' or 'spans', not {how!r}")
    spark, place = docs.sparkSession, docs.columns.index(text)
    bounded(spark)

    def cut(column: pa.Array, hits: list[np.ndarray]) -> pa.Array:
        return pa.array([old if not len(h) else cut_spans(t, h).decode() for old, t, h in zip(column.to_pylist(), as_bytes(column), hits, strict=True)], column.type)

    with Scratch(spark) as held:
        blocks = benchmark_blocks(benchmark, item_key, item_text, block_bytes, held)
        first, second = next(blocks, []), next(blocks, None)
        if second is None:
            sent = spark.sparkContext.broadcast(WindowSet(first, window))

            def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    hits = [hit for _, hit, _ in scanned(as_bytes(part.column(place)), sent.value)]
                    if how == "documents":
                        yield part.filter(pa.array([not len(h) for h in hits], pa.bool_()))
                    else:
                        yield part.set_column(place, part.schema.field(place), cut(part.column(place), hits))

            return docs.mapInArrow(run, docs.schema)
        docs = stable(docs)
        source = row_ids(docs, [key, text]).toDF("uid", "doc_id", "text")
        found = hits_by_block(source, itertools.chain([first, second], blocks), window, docs.schema[key].dataType.simpleString(), held, every=False)
        uid, hit = fresh(docs, "uid"), fresh(docs, "hit")
        hits = written(united(found).select(F.col("uid").alias(uid), F.col("hit").alias(hit)), "benchmark-hits")
    numbered, own = docs.withColumn(uid, F.monotonically_increasing_id()), [F.col(f"`{c}`") for c in docs.columns]
    if how == "documents":
        return numbered.join(hits, uid, "left_anti").select(*own)
    width = len(docs.columns)

    def both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hits = [np.array(h or [], np.int64) for h in part.column(width).to_pylist()]
            rest = part.select(list(range(width)))
            yield rest.set_column(place, rest.schema.field(place), cut(part.column(place), hits))

    return numbered.join(hits, uid, "left").select(*own, hit).mapInArrow(both, docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), dw AS (
  SELECT uid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT uid, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram
), pos AS (
  SELECT uid, count(DISTINCT p) AS n_hit
  FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT uid, i, n FROM hit)) GROUP BY uid
), its AS (
  SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT uid, item FROM hit) GROUP BY uid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (uid) LEFT JOIN its USING (uid)
"""
