"""Near duplicates by the similarity of their word shingles: fingerprints at anchors find them, a prefix-filtered join finds the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, as_bytes, row_ids, stable
from paperloom.llm.graph import star_components
from paperloom.llm.simhash import distinct, fingerprint_of, kept_rows, members, near_links, shingle_hashes

#: Words of a shingle, and the least similarity of a link in tenths: shared shingles by all shingles of both.
SHINGLE, TENTHS = 5, 8
#: Counters of the shingles of one document in SAMPLE; they only order shingles, so their errors lose nothing.
SLOTS, SAMPLE = 1 << 20, 16
#: Documents with a common shingle up to which all pairs are candidates at once, and the heads that more are compared with first.
SMALL, HEADS = 64, 16
#: Bits below a document's number of shingles that hold how common its shingles are.
CENTRAL_BITS = 20
#: Rows that a task looks at together, and bits of the filter of documents that are candidates.
ROWS, FILTER_BITS = 200_000, 1 << 23


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text without words has the hash 0 alone."""
    return set_of(shingle_hashes(text, SHINGLE))


def set_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.astype("<u8").tobytes())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * shared >= TENTHS * (len(a) + len(b) - shared)


def prefix(grams: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The shingles that come first in the order of ``slots`` and hash: two similar sets share one of theirs.

    Similar sets share ``TENTHS`` tenths of the larger or more, so what a set has beyond that many, and one more, can't
    all be missing from the other. This holds for any order that is the same for all sets.
    """
    by = np.lexsort((grams, slots[(grams % np.uint64(SLOTS)).astype(np.int64)]))
    return grams[by[: len(grams) - -(-TENTHS * len(grams) // 10) + 1]]


def sets_of(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    return map(shingle_set, as_bytes(part.column(1)))


def longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(c).astype(np.uint64).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def centrality(grams: np.ndarray, slots: np.ndarray) -> int:
    """How common a document's shingles are: the mean of their counts' logarithms, in thousandths."""
    return min((1 << CENTRAL_BITS) - 1, int(1000 * np.log2(1.0 + slots[(grams % np.uint64(SLOTS)).astype(np.int64)]).mean()))


def slot_counts(source: DataFrame) -> np.ndarray:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            slots, n = np.unique(np.concatenate([g % np.uint64(SLOTS) for g in sets_of(part)] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(longs(slots, n), names=["slot", "n"])

    counts = source.filter(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return out


def in_groups(each, names: list[str]):
    """A function over rows sorted by their first column: ``each(columns)`` gets whole groups, some at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for found in each(columns):
                yield pa.RecordBatch.from_arrays(longs(*found), names=names)

        for part in parts:
            held.append([c.to_numpy() for c in part.columns])
            rows += part.num_rows
            if rows >= ROWS:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                yield from out([c[:cut] for c in columns])
                held, rows = [[c[cut:] for c in columns]], 0
        if held:
            yield from out([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def alike(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sets of such sizes can be similar."""
    return 10 * np.minimum(n[a], n[b]) >= TENTHS * np.maximum(n[a], n[b])


def candidates(columns: list[np.ndarray]) -> Iterator[tuple]:
    """``gram, a, b, n, m``: pairs of documents with the shingle and their sizes, gram 0; and documents ``a`` of ``n``
    shingles with a very common one, b = a and m = n.

    Of the documents with a very common shingle, the heads are those whose shingles are the most common: what others were
    copied from, with the least changes of its own, so that most of a large group links to them.
    """
    gram, node, both = columns
    n, central = both >> CENTRAL_BITS, both & ((1 << CENTRAL_BITS) - 1)
    starts, sizes = groups_of(gram)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    end = np.repeat(starts + sizes, sizes)

    def pairs(x: np.ndarray, y: np.ndarray) -> tuple:
        ok = alike(n, x, y) & (node[x] != node[y])
        x, y = x[ok], y[ok]
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        return np.zeros(len(x), np.int64), node[x], node[y], n[x], n[y]

    for step in range(1, SMALL):
        at = at[at + step < end[at]]
        if not len(at):
            break
        yield pairs(at, at + step)
    for k in np.flatnonzero(sizes > SMALL):
        place = np.arange(starts[k], starts[k] + sizes[k])
        place = place[np.unique(node[place], return_index=True)[1]]
        for head in place[np.lexsort((node[place], -central[place]))[:HEADS]]:
            yield pairs(place[place != head], np.full(len(place) - 1, head))
        yield np.full(len(place), gram[starts[k]] | 1), node[place], node[place], n[place], n[place]


def enough(found: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of candidates that share as many of their first shingles as similar documents do.

    Similar sets share 8 of 18 of both sizes or more, so only what a set has beyond that can be missing from the other. Of
    the set whose first shingles end sooner in the order, all first shingles but the missing ones are among the other's
    first ones, too. Very common shingles are not paired up, so all that both documents have of these count as shared.
    """
    common = found.filter("gram <> 0").groupBy("a").agg(F.count("*").alias("common"))
    pairs = found.filter("gram = 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    shared = pairs.join(common.toDF("a", "common_a"), "a", "left").join(common.toDF("b", "common_b"), "b", "left")
    both = F.ceil((F.col("n") + F.col("m")) * TENTHS / (10 + TENTHS) - F.lit(1e-9))

    def needed(size: str):
        first = F.col(size) - F.ceil(F.col(size) * TENTHS / 10 - F.lit(1e-9)) + 1
        return first - (F.col(size) - both)

    seen = F.col("shared") + F.least(F.coalesce("common_a", F.lit(0)), F.coalesce("common_b", F.lit(0)))
    return shared.filter(seen >= F.least(needed("n"), needed("m"))).select("a", "b")


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many of their first shingles similar sets of such sizes share (see ``enough``), at least one."""
    both, first = -(-TENTHS * (n + m) // (10 + TENTHS)), lambda x: x + TENTHS * x // -10 + 1
    return np.maximum(1, np.minimum(first(n) - (n - both), first(m) - (m - both)))


def across(columns: list[np.ndarray]) -> Iterator[tuple]:
    """``a, b``: pairs of documents with a very common shingle that no links join yet.

    ``count`` is the number of very common ones among a document's first shingles, and ``rank`` the place of this one
    there. Pairs that share others too are candidates already. Similar ones share ``needed`` of these, and the first that
    they share has as many places after it in both documents; pairs where it does not are left out here.
    """
    gram, node, n, root, count, rank = columns
    for start, size in zip(*groups_of(gram), strict=True):
        place = np.arange(start, start + size)
        if (root[place] == root[start]).all():
            continue
        _, numbers, own = np.unique(root[place], return_inverse=True, return_counts=True)
        most, pairs = numbers == own.argmax(), []
        for at in place[~most]:
            ok = place[(most | (place > at)) & (root[place] != root[at])]
            ok = ok[alike(n, ok, np.full(len(ok), at))]
            need = needed(n[ok], np.full(len(ok), n[at]))
            ok = ok[(rank[ok] <= count[ok] - need) & (rank[at] <= count[at] - need)]
            pairs.append((node[ok], np.full(len(ok), node[at])))
            if len(pairs) * size > ROWS or at == place[~most][-1]:
                yield tuple(np.concatenate(x) for x in zip(*pairs, strict=True))
                pairs = []


def verified(source: DataFrame, heads: DataFrame, pairs: DataFrame, held: Scratch) -> DataFrame:
    """The pairs ``a, b`` whose whole sets of shingles are similar; only texts that a pair needs are read into sets."""
    pairs = held.written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidate-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(heads, "fp").select(F.pmod(F.xxhash64("head.uid"), F.lit(FILTER_BITS)).alias("bit")).distinct().toArrow()
    wanted = np.zeros(FILTER_BITS, bool)
    wanted[ends.column("bit").to_numpy()] = True
    bits = source.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bit = part.column(2).to_numpy()
            part = part.filter(pa.array((bits.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)))
            if part.num_rows:
                grams = list(sets_of(part))
                nodes = np.array([node_of(g) for g in grams], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), *longs(nodes), pa.array([g.tobytes() for g in grams], pa.binary())], names=["uid", "fp", "grams"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            left, right = ([np.frombuffer(x, np.uint64) for x in part.column(k).to_pylist()] for k in (2, 3))
            ok = pa.array([similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    found = source.withColumn("bit", F.pmod(F.xxhash64("uid"), F.lit(FILTER_BITS))).mapInArrow(sets, "uid long, fp long, grams binary")
    own = held.written(found.join(heads.select("fp", F.col("head.uid").alias("uid")), ["fp", "uid"], "left_semi").select("fp", "grams"), "candidate-sets")
    both = pairs.join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b").select("a", "b", "left", "right")
    out = held.written(both.mapInArrow(run, "a long, b long"), "similar-pairs")
    held.drop(pairs, own)
    return out


def anchored(texts: DataFrame, firsts: DataFrame, heads: DataFrame, held: Scratch) -> DataFrame:
    """The links ``a, b`` that SimHash fingerprints find: those that meet at anchors of the covering code (see ``near_links``) are
    the candidates, and so are the sets of one fingerprint; each link is verified on the whole sets."""
    prints = held.written(firsts.groupBy("fp").agg(F.min("print").alias("print")), "set-fingerprints")
    first = held.written(prints.groupBy("print").agg(F.min("fp").alias("first")), "first-sets")
    near = near_links(first.select(F.col("print").alias("fp")))
    apart = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = prints.join(first, "print").filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return verified(texts, heads, apart.unionByName(equal), held)


def unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that no links join."""
    roots = star_components(links)
    rooted = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    return rooted.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``uid, doc_id, fp, component_id, kept``.

    Documents link whose sets of ``SHINGLE``-word shingles have a similarity of ``TENTHS`` tenths or more, and links
    chain; ``fp`` is a hash of the set. Links are looked for by SimHash fingerprints at the anchors of a covering code first.
    Fingerprints cannot promise to find all, so of documents that these links do not join yet all that share one of the
    first shingles of both (see ``prefix``) are candidates, too: no similar pair is lost, and every link is verified on the whole sets. Rare shingles come first, so a very common line
    attracts only documents that consist of little else. Documents with a common shingle are compared with a few heads
    first, then each with those that it isn't linked to yet and that share enough more. Ids, null texts and empty tables as in ``near_groups``.
    """
    source = row_ids(stable(docs), [key, text]).toDF("uid", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = source.select("uid", "text")
    slots = source.sparkSession.sparkContext.broadcast(slot_counts(texts))

    def ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            firsts, nodes, prints = [], [], []
            for text in as_bytes(part.column(1)):
                hashes = shingle_hashes(text, SHINGLE)
                grams = set_of(hashes)
                prints.append(fingerprint_of(hashes))
                both = len(grams) << CENTRAL_BITS | centrality(grams, slots.value)
                firsts.append(np.concatenate((np.array([both], np.uint64), prefix(grams, slots.value))).tobytes())
                nodes.append(node_of(grams))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *longs(np.array(nodes, np.uint64), np.array(prints, np.uint64)), pa.array(firsts, pa.binary())], names=["uid", "doc_id", "fp", "print", "first"])

    with Scratch(source.sparkSession) as held:
        return linked(source, held.written(source.select("uid", "text", "doc_id").mapInArrow(ids, "uid long, doc_id long, fp long, print long, first binary"), "shingle-prefixes"), held)


def linked(source: DataFrame, firsts: DataFrame, held: Scratch) -> DataFrame:
    """The groups of ``source(uid, doc_id, text)`` with their fingerprints and first shingles ``firsts(uid, doc_id, fp, print, first)``."""

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            firsts = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
            if firsts:
                sizes = [len(x) - 1 for x in firsts]
                yield pa.RecordBatch.from_arrays(longs(np.concatenate([x[1:] for x in firsts]), np.repeat(part.column(0).to_numpy(), sizes), np.repeat([x[0] for x in firsts], sizes)), names=["gram", "fp", "n"])

    texts, rows = source.select("uid", "text"), firsts.select("uid", "doc_id", "fp")
    heads = distinct(rows, held)
    grams = firsts.select("fp", "first").mapInArrow(spread, "gram long, fp long, n long").repartition("gram").sortWithinPartitions("gram")
    found = held.written(grams.mapInArrow(in_groups(candidates, ["gram", "a", "b", "n", "m"]), "gram long, a long, b long, n long, m long"), "candidates")
    links = anchored(texts, firsts, heads, held)
    links = links.unionByName(verified(texts, heads, unlinked(enough(found), links), held))
    common = found.filter("gram <> 0").select("gram", F.col("a").alias("node"), "n")
    if not common.isEmpty():
        own = Window.partitionBy("node")
        common = common.withColumn("count", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("gram")) - 1)
        rooted = common.join(star_components(links), "node", "left").select("gram", "node", "n", F.coalesce("root", "node").alias("root"), F.col("count").cast("long").alias("count"), F.col("rank").cast("long").alias("rank"))
        rest = rooted.repartition("gram").sortWithinPartitions("gram").mapInArrow(in_groups(across, ["a", "b"]), "a long, b long")
        links = links.unionByName(verified(texts, heads, rest, held))
    return members(rows, heads, links, held)


def similar_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of similar documents."""
    docs = stable(docs)
    return kept_rows(docs, similar_groups(docs, key, text))
