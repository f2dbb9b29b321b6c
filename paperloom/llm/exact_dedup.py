"""Exact deduplication with Grace hash partitioning."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import ASCII_SPACE, Scratch, as_bytes, documents, fresh, row_ids, stable, written

#: Bytes of content that one open-addressing table may hold before its bucket is partitioned further.
TABLE_BYTES = 96 << 20
#: Spill files of one partitioning step.
FANOUT = 16
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def squeezed(text: bytes) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space."""
    inner = b" ".join(text.split())
    if not inner:
        return b" " if text else b""
    return (b" " if text[0] in ASCII_SPACE else b"") + inner + (b" " if text[-1] in ASCII_SPACE else b"")


class ContentTable:
    """Open addressing over whole contents: a slot matches only when the contents are equal byte for byte."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, content: bytes, code: int) -> int:
        """The number of this content, in order of first appearance."""
        mask = len(self.slots) - 1
        at = code & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == code and self.contents[k] == content:
                return int(k)
            at = (at + 1) & mask
        self.slots[at] = k = len(self.contents)
        self.hashes.append(code)
        self.contents.append(content)
        self.bytes += len(content) + 120
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for k, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(records: Iterable[tuple[bytes, tuple]], table_bytes: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, list[tuple]]]:
    """Groups ``(content, row)`` by content: yields each distinct content with its rows.

    Contents fill one table. When they exceed ``table_bytes``, contents already in the table stay there and take their
    copies, all others go to ``FANOUT`` spill files by a hash of their own for this depth, and each file is grouped by
    itself. One content is never split, and every step puts at least one content in a table, so the recursion ends.
    """
    table, rows = ContentTable(), []
    spills: list | None = None
    try:
        for content, row in records:
            code = xxhash.xxh64_intdigest(content, seed=depth)
            if spills is None:
                k = table.place(content, code >> 6)
                if k == len(rows):
                    rows.append([])
                rows[k].append(row)
                if table.bytes > table_bytes:
                    spills = [tempfile.TemporaryFile(prefix="grace-", dir=spill_dir()) for _ in range(FANOUT)]  # noqa: SIM115
                continue
            k = find(table, content, code >> 6)
            if k >= 0:
                rows[k].append(row)
            else:
                pickle.dump((content, row), spills[code % FANOUT], protocol=5)
        yield from zip(table.contents, rows, strict=True)
        del table, rows
        for spill in spills or []:
            spill.seek(0, os.SEEK_SET)
            yield from grace(unpickled(spill), table_bytes, depth + 1)
            spill.close()
    finally:
        for spill in spills or []:
            spill.close()


def spill_dir() -> str | None:
    """The first of the folders that Spark gives this worker for spilled data; a plain Python process has none."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


def find(table: ContentTable, content: bytes, code: int) -> int:
    """The number of a content that the table has, else -1."""
    mask = len(table.slots) - 1
    at = code & mask
    while (k := table.slots[at]) >= 0:
        if table.hashes[k] == code and table.contents[k] == content:
            return int(k)
        at = (at + 1) & mask
    return -1


def unpickled(file) -> Iterator[tuple[bytes, tuple]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


LOCAL = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("text_sha256", pa.string()), ("content", pa.binary())])
GROUPS = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64()), ("pad", pa.binary())])
LAST = (1 << 63) - 1


def order(doc_id: int | None, uid: int) -> tuple:
    return (doc_id is None, doc_id or 0, uid)


def locally_grouped(table_bytes: int):
    """Within a task: every row gets the representative of its content; only representatives carry the content."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for part in parts:
                for uid, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                    yield squeezed(text), (uid, doc_id)

        def rows():
            for content, members in grace(records(), table_bytes):
                digest = hashlib.sha256(content).hexdigest()
                rep, _ = min(members, key=lambda m: order(m[1], m[0]))
                for uid, doc_id in members:
                    head = uid == rep
                    yield uid, doc_id, rep, len(members) if head else None, digest, content if head else None

        yield from batches(rows(), LOCAL)

    return run


def globally_grouped(table_bytes: int):
    """Within a bucket: equal contents of different tasks meet, and the least representative of each stays."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for part in parts:
                uid, doc_id, copies = (part.column(k).to_pylist() for k in range(3))
                yield from zip(as_bytes(part.column(3)), zip(uid, doc_id, copies, strict=True), strict=True)

        def rows():
            for _, members in grace(records(), table_bytes):
                uid, doc_id, _ = min(members, key=lambda m: order(m[1], m[0]))
                total = sum(m[2] for m in members)
                for m in members:
                    yield m[0], doc_id, uid, total, None

        yield from batches(rows(), GROUPS)

    return run


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``uid, doc_id, keep_id, group_size, kept, text_sha256``.

    Grace hash deduplication in two rounds. Round one groups each scan task's own rows, so a group of copies of any size
    reaches the shuffle with one record a task. Round two shuffles these records, whole contents included, by hash into
    buckets; a bucket whose contents exceed ``table_bytes`` is partitioned again into spill files until each fits a table
    that compares complete contents. The answer goes back to the rows by their representative, whose rows are those of
    one scan task at most.

    Nulls: a null text equals an empty one; a null id sorts after all others. Repeated rows: exactly one row of a
    group has ``kept`` true, even when several have the least id. An empty table gives an empty result. Other columns
    of ``docs`` are not read. A very long text is one record, compared whole. The answer is written, without texts, when
    this returns, and the texts that it was made from are removed.
    """
    source = row_ids(docs, [key, text]).toDF("uid", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    with Scratch(docs.sparkSession) as held:
        local = held.written(source.mapInArrow(locally_grouped(table_bytes), "uid long, doc_id long, rep long, copies long, text_sha256 string, content binary"), "exact-local")
        heads = local.filter(F.col("copies").isNotNull())
        buckets = heads.select("uid", "doc_id", "copies", "content", "text_sha256").repartition("text_sha256").drop("text_sha256")
        groups = held.written(buckets.mapInArrow(globally_grouped(table_bytes), "rep long, keep_id long, keep_uid long, group_size long, pad binary").drop("pad"), "exact-groups")
        rows = local.select("uid", "doc_id", "rep", "text_sha256")
        return written(rows.join(groups, "rep").select("uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"), "exact-rows")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without the later copies of a text."""
    docs = stable(docs)
    uid = fresh(docs, "uid")
    kept = exact_groups(docs, key, text, table_bytes).filter("kept").select(F.col("uid").alias(uid))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(kept, uid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
