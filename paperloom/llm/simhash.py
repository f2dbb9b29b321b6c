"""Near duplicates: SimHash fingerprints compared at the anchors of a covering code."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, as_bytes, documents, fresh, row_ids, spaced_words, stable, written
from paperloom.llm.graph import star_components

BITS = 64
#: Words of a shingle, seed of its hash, and differing bits of a link.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Parity checks of the covering code of a block.
CHECKS = 4
#: Blocks of a fingerprint. Fewer have far more anchors, each with fewer fingerprints.
BLOCKS = 3
#: Fingerprints that one comparison holds; an anchor that attracts more is dealt out in tiles.
TILE = 20_000
#: One fingerprint in so many tells which anchors need tiles.
PROBE = 64
#: Rows compared at once, and members of an anchor up to which all of its pairs are looked at together.
ROWS, SMALL = 200_000, 128


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hash of each run of so many words, or of all words where they are fewer; none without words."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    cuts = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, last)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit j is 1 if it is set in over half of the shingles' hashes; 0 without any."""
    last = len(hashes)
    if not last:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, 4096):
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``uid, doc_id, fp`` of every row; ``fp`` is the fingerprint's bits as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.fromiter((fingerprint(t, shingle) for t in as_bytes(part.column(2))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], names=["uid", "doc_id", "fp"])

    source = row_ids(docs, [key, text]).toDF("uid", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "uid long, doc_id long, fp long")


def block_widths(blocks: int) -> list[int]:
    return [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]


def columns_of(width: int) -> list[int]:
    """The parity-check columns of a block's bits: every nonzero value occurs, so the covering radius is 1."""
    return [i % ((1 << CHECKS) - 1) + 1 for i in range(width)]


def code_table(blocks: int, distance: int) -> list[tuple[int, int, int]]:
    """``block, syndrome, flips``: flipping these bits of a word with that syndrome leads to an anchor.

    An anchor is a word whose syndrome is 0. Two fingerprints that differ in ``distance`` bits differ in at most
    ``distance // blocks`` bits of some block; an anchor within radius 1 of one of them there is then within
    ``1 + distance // blocks`` of the other, and the table has all flips of so many bits.
    """
    radius, rows = 1 + distance // blocks, []
    for block, width in enumerate(block_widths(blocks)):
        cols = columns_of(width)
        for weight in range(radius + 1):
            for bits in itertools.combinations(range(width), weight):
                syndrome, flips = 0, 0
                for i in bits:
                    syndrome ^= cols[i]
                    flips |= 1 << i
                rows.append((block, syndrome, flips))
    return rows


def at_anchors(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """``block, anchor, fp``: each fingerprint at every anchor within reach, block by block."""
    spark, shift, parts = fps.sparkSession, 0, []
    for block, width in enumerate(block_widths(blocks)):
        word = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        cols = columns_of(width)
        masks = [sum(1 << i for i, c in enumerate(cols) if c >> j & 1) for j in range(CHECKS)]
        parity = [F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), j) for j, m in enumerate(masks)]
        syndrome = parity[0]
        for p in parity[1:]:
            syndrome = syndrome.bitwiseOR(p)
        parts.append(F.struct(F.lit(block).alias("block"), syndrome.cast("int").alias("syndrome"), word.cast("long").alias("word")))
        shift += width
    flips = spark.createDataFrame(code_table(blocks, distance), "block int, syndrome int, flips long")  # some thousand rows at most
    words = fps.select("fp", F.explode(F.array(*parts)).alias("w")).select("fp", "w.*")
    return words.join(F.broadcast(flips), ["block", "syndrome"]).select("block", F.col("word").bitwiseXOR(F.col("flips")).alias("anchor"), "fp")


def clusters(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the fingerprints of each cluster to one of them; found ones aren't compared again."""
    left, out = np.unique(fps), []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= distance
            if near.any():
                found, left = left[near], left[~near]
                out.append((found, np.full(len(found), root)))
                front.extend(found)
    return out


def links_of(anchors: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within anchors, which are sorted: at small anchors by looking at all pairs at once, else by clusters."""
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    sizes = np.diff(np.append(starts, len(anchors)))
    out = []
    for k in np.flatnonzero(sizes > SMALL):
        out += clusters(fps[starts[k] : starts[k] + sizes[k]], distance)
    end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for step in range(1, SMALL):
        at = at[at + step < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        out.append((fps[near], fps[near + step]))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
    return stars(a, b)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links to their least members."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def compared(distance: int):
    """Rows ``place, fp`` sorted by place; yields links ``a, b``. Only one place's rows and ``ROWS`` more are held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, fps, rows = [], [], 0

        def out(p: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = links_of(p, f.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for part in parts:
            places.append(part.column(0).to_numpy())
            fps.append(part.column(1).to_numpy())
            rows += part.num_rows
            if rows >= ROWS:
                p, f = np.concatenate(places), np.concatenate(fps)
                cut = int(np.searchsorted(p, p[-1])) if p[0] != p[-1] else 0
                if cut:
                    yield out(p[:cut], f[:cut])
                places, fps, rows = [p[cut:]], [f[cut:]], 0
        if places and sum(map(len, places)):
            yield out(np.concatenate(places), np.concatenate(fps))

    return run


def near_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that connect all of the distinct ``fp`` that are ``distance`` or fewer bits apart.

    Anchor points: each fingerprint goes to the anchors within covering radius plus threshold, and is compared with what
    else is there. An anchor that attracts more than about ``tile`` fingerprints is split: they are dealt into slices,
    and each pair of slices is compared in a tile of its own, so no task has to hold or compare them all. ``blocks``
    changes the plan, not the links: with 3 a fingerprint goes to about 45 anchors, with 2 to about 690 smaller ones.
    """
    replicas = at_anchors(fps, blocks, distance)
    probe = at_anchors(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(PROBE)) == 0), blocks, distance)
    hot = written(probe.groupBy("block", "anchor").count().filter(F.col("count") > F.lit(tile / PROBE / 2)).select("block", "anchor", F.ceil(F.col("count") * PROBE * 2 / tile).cast("int").alias("m")), "hot-anchors")
    if hot.isEmpty():
        placed = replicas.select(F.xxhash64("block", "anchor").alias("place"), "fp")
    else:
        m, own = F.coalesce("m", F.lit(1)), F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("m", F.lit(1))).cast("int")
        tiled = replicas.join(hot, ["block", "anchor"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
        placed = tiled.select(F.xxhash64("block", "anchor", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "fp")
    return placed.repartition("place").sortWithinPartitions("place").mapInArrow(compared(distance), "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``uid, doc_id, fp, component_id, kept``.

    Rows whose fingerprints are ``distance`` or fewer bits apart are linked, and links chain. Equal fingerprints are
    compared once, whatever the number of their rows. ``component_id`` is the least doc_id of the component; ``kept`` is
    true for one row of it, the first with that id. Null or empty texts have fingerprint 0 and link like others; null
    ids sort last. An empty table gives an empty result; other columns are not read.
    """
    with Scratch(docs.sparkSession) as held:
        rows = held.written(fingerprinted(docs, key, text, shingle), "fingerprints")
        fps = distinct(rows, held)
        return members(rows, fps, near_links(fps.select("fp"), distance, blocks, tile), held)


def distinct(rows: DataFrame, held: Scratch) -> DataFrame:
    """``fp, head``: the first of the rows with each ``fp``."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    return held.written(rows.groupBy("fp").agg(head.alias("head")), "distinct-fingerprints")


def members(rows: DataFrame, fps: DataFrame, links: DataFrame, held: Scratch) -> DataFrame:
    """``uid, doc_id, fp, component_id, kept`` for ``rows(uid, doc_id, fp)`` and links of their distinct ``fp``, written."""
    roots = star_components(links).withColumnRenamed("node", "fp")
    rooted = held.written(fps.join(roots, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    heads = held.written(rooted.groupBy("root").agg(F.min("head").alias("head")), "component-heads")
    own = rooted.select("fp", "root").join(heads, "root").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.uid").alias("head_uid"))
    return written(rows.join(own, "fp").select("uid", "doc_id", "fp", "component_id", (F.col("uid") == F.col("head_uid")).alias("kept")), "near-groups")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near duplicates."""
    docs = stable(docs)
    return kept_rows(docs, near_groups(docs, key, text, **options))


def kept_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    uid = fresh(docs, "uid")
    kept = groups.filter("kept").select(F.col("uid").alias(uid))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(kept, uid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
