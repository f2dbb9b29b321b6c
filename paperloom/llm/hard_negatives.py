"""Hard negatives for contrastive training: exact inner-product search over inverted lists with centroid radii."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import centroids_of, matrix, nearest, same_width
from paperloom.llm.common import Scratch, bounded, fresh, written

#: Inverted lists, and the most rows of the sample that their centroids are fitted on (on average half of it).
LISTS, SAMPLE = 128, 16_384
#: Rows of a slice of a list, and anchors of a tile: what one comparison holds.
SLICE, TILE = 2048, 512
#: Lists that each anchor visits first, those with the highest bounds; what it finds there tells which others it needs.
FIRST = 8
#: Integer components and inner products that are exact: of 32 bits, and below this.
COMPONENT, EXACT, WHOLE = 2**31 - 1, 2**53, 2**62
#: Bounds are taken this much wider, for what is lost in floating point.
SLACK = 1e-9


def integers(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of every component."""
    out = np.floor(scale * matrix(column))
    if np.abs(out).max(initial=0) > COMPONENT:
        raise ValueError("a component times the scale does not fit 32 bits")
    return out


def packed(vectors: np.ndarray) -> bytes:
    return vectors.astype("<i4").tobytes()


def unpacked(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4").reshape(rows, -1).astype(np.float64) if rows else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    a, b = same_width(a, b)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most >= WHOLE:
        raise ValueError("inner products do not fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def assigned(rows: DataFrame, scale: float, centroids: np.ndarray) -> DataFrame:
    """``uid, id, label, anchor, list, distance, vec``: each row in the list of its nearest centroid."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            whole = integers(part.column(4), scale)
            own, far = nearest(whole, centroids)
            blobs = [packed(v) for v in whole]
            columns = [*part.columns[:4], pa.array(own), pa.array(far), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "id", "label", "anchor", "list", "distance", "vec"])

    return rows.mapInArrow(run, "uid long, id long, label long, anchor boolean, list long, distance double, vec binary")


def vectors_of(blobs: list[bytes]) -> np.ndarray:
    """Vectors of one row each, filled up with zeros to the longest."""
    width = max(map(len, blobs), default=0)
    return unpacked(b"".join(b.ljust(width, b"\0") for b in blobs), len(blobs))


def in_runs(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that are equal in the first column, of at most so many rows each."""
    held: list[pa.RecordBatch] = []
    key = None

    def tables() -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        held.clear()
        for at in range(0, table.num_rows, most):
            yield table.slice(at, most)

    for part in parts:
        own = part.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and (own[a] != key or sum(h.num_rows for h in held) >= most):
                yield from tables()
            key = own[a]
            held.append(part.slice(a, b - a))
    if held:
        yield from tables()


def slices(rows: DataFrame) -> DataFrame:
    """``list, n, uids, ids, labels, vecs, radius``: the lists in slices of ``SLICE`` rows at most, by id, null ids last.

    The rows are dealt out by list and evenly: a list with very many rows goes to many tasks, each of which makes slices of its own.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(parts, SLICE):
            whole = vectors_of(table.column("vec").to_pylist())
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("uid", "id", "label")]
            radius = pa.array([float(table.column("distance").to_numpy().max())])
            yield pa.RecordBatch.from_arrays([table.column(0)[:1].combine_chunks(), pa.array([table.num_rows]), *lists, pa.array([packed(whole)], pa.binary()), radius], names=["list", "n", "uids", "ids", "labels", "vecs", "radius"])

    dealt = rows.select("list", "uid", "id", "label", "distance", "vec").hint("rebalance", "list")
    return dealt.sortWithinPartitions("list", F.col("id").asc_nulls_last(), "uid").mapInArrow(run, "list long, n long, uids array<long>, ids array<long>, labels array<long>, vecs binary, radius double")


def grid(column: pa.Array, width: int, missing: int) -> np.ndarray:
    """A list column with ``width`` values a row as a matrix; nulls as ``missing``."""
    return column.flatten().fill_null(missing).to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width), np.int64)


NO_KTH = -(2**63)


def visits(anchors: DataFrame, centroids: np.ndarray, radii: np.ndarray, width: int, first: int | None, skip: int) -> DataFrame:
    """A row for each list that an anchor has to visit: the ``first`` ones in the order of their bounds, or those after ``skip``.

    By Cauchy and Schwarz an inner product with a list's rows is within ``norm * radius`` of that with its centroid. A list is
    left out if for each window of the anchor these bounds lie outside, or the upper one is strictly below the k-th score so far.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            whole = vectors_of(part.column(2).to_pylist())
            vectors, middles = same_width(whole, centroids)
            at, reach = vectors @ middles.T, np.linalg.norm(vectors, axis=1)[:, None] * radii
            slack = 1 + SLACK * (np.abs(at) + reach)
            upper, lower = at + reach + slack, at - reach - slack
            low, high, kth = (grid(part.column(c), width, NO_KTH) for c in (3, 4, 5))
            needed = np.zeros(at.shape, bool)
            for w in range(width):
                top = np.minimum(upper, high[:, w, None])
                needed |= (lower <= high[:, w, None]) & (top >= low[:, w, None]) & (top >= kth[:, w, None]) & (low[:, w, None] <= high[:, w, None])
            place = np.empty(at.shape, np.int64)
            np.put_along_axis(place, np.argsort(-upper, axis=1, kind="stable"), np.arange(at.shape[1])[None, :], axis=1)
            needed &= (place >= skip) & (place < (first or at.shape[1]))
            row, own = np.nonzero(needed & (radii >= 0))
            for a in range(0, len(row), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 4096]), *(c.take(pa.array(row[a : a + 4096])) for c in part.columns)], names=["list", *part.schema.names])

    return anchors.mapInArrow(run, "list long, aid long, label long, vec binary, low array<long>, high array<long>, kth array<long>")


def tiles(visiting: DataFrame) -> DataFrame:
    """Visits of the same list, ``TILE`` at most in a row; a list that very many anchors visit is packed by many tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(parts, TILE):
            flat = [pa.array([table.column(c).combine_chunks().flatten().to_pylist()], pa.list_(pa.int64())) for c in ("low", "high", "kth")]
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("aid", "label")]
            whole = vectors_of(table.column("vec").to_pylist())
            yield pa.RecordBatch.from_arrays([table.column(0)[:1].combine_chunks(), *lists, pa.array([packed(whole)], pa.binary()), *flat], names=["list", "aids", "anchor_labels", "anchor_vecs", "low", "high", "kth"])

    return visiting.hint("rebalance", "list").sortWithinPartitions("list").mapInArrow(run, "list long, aids array<long>, anchor_labels array<long>, anchor_vecs binary, low array<long>, high array<long>, kth array<long>")


def met(tiling: DataFrame, index: DataFrame) -> DataFrame:
    """A row for each tile and slice of the same list.

    Merged, since Spark takes tiles for as large as the anchors that they are made of: an anchor is in a tile of each list
    that it visits, so few anchors by their bytes would be broadcast as very many tiles.
    """
    return tiling.hint("merge").join(index.hint("merge"), "list")


def best_of_pairs(pairs: DataFrame, centroids: np.ndarray, width: int, k: int, same: bool) -> DataFrame:
    """``aid, w, score, id, uid``: the first ``k`` rows of a slice for each anchor and window of a tile that visits it."""

    def found(own: dict) -> Iterator[pa.RecordBatch]:
        anchors, rows = unpacked(own["anchor_vecs"], len(own["aids"])), unpacked(own["vecs"], own["n"])
        aids, uids = np.array(own["aids"]), np.array(own["uids"])
        low, high, kth = (np.array([NO_KTH if x is None else x for x in own[c]], np.int64).reshape(-1, width) for c in ("low", "high", "kth"))
        vectors, middle = same_width(anchors, centroids[own["list"]][None, :])
        at = vectors @ middle[0]
        reach = np.linalg.norm(vectors, axis=1) * own["radius"]
        slack = 1 + SLACK * (np.abs(at) + reach)
        near = ((at + reach + slack)[:, None] >= np.maximum(kth, low)).any(1) & ((at - reach - slack)[:, None] <= high).any(1)
        if not near.any():
            return
        aids, low, high, kth = aids[near], low[near], high[near], kth[near]
        scores = products(anchors[near], rows)
        labels = np.array(own["anchor_labels"])[near]
        right = (labels[:, None] == np.array(own["labels"])[None, :]) == same
        right &= aids[:, None] != uids[None, :]
        n = own["n"]
        for w in range(width):
            fit = right & (scores >= np.maximum(low, kth)[:, w, None]) & (scores <= high[:, w, None])
            who, where = np.nonzero(fit)
            if n > k and len(who) > k * len(aids):
                # The k-th score of each anchor here: only what reaches it, ties included, has to be put in order.
                reached = np.where(fit, scores, NO_KTH)
                fit &= scores >= np.partition(reached, n - k, axis=1)[:, n - k, None]
                who, where = np.nonzero(fit)
            value = scores[who, where]
            order = np.lexsort((where, -value, who))
            who, where, value = who[order], where[order], value[order]
            begins = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))[: len(who)]
            place = np.arange(len(who)) - np.repeat(begins, np.diff([*begins, len(who)]))
            keep = place < k
            who, where, value = who[keep], where[keep], value[keep]
            ids = pa.array(own["ids"], pa.int64()).take(pa.array(where))
            yield pa.RecordBatch.from_arrays([pa.array(aids[who]), pa.array(np.full(len(who), w)), pa.array(value), ids, pa.array(uids[where])], names=["aid", "w", "score", "id", "uid"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = part.schema.names
            for at in range(part.num_rows):
                yield from found(dict(zip(names, (column[at].as_py() for column in part.columns), strict=True)))

    return pairs.mapInArrow(run, "aid long, w long, score long, id long, uid long")


def searched(index: DataFrame, anchors: DataFrame, centroids: np.ndarray, radii: np.ndarray, width: int, k: int, same: bool, scratch: Scratch, first: int) -> DataFrame:
    """``aid, w, score, id, uid, place``: the first ``k`` rows for each window of ``anchors(aid, label, vec, low, high)``, by score, then by id."""
    order = Window.partitionBy("aid", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")

    def visited(states: DataFrame, until: int | None, skip: int, before: DataFrame | None) -> DataFrame:
        pairs = met(tiles(visits(states, centroids, radii, width, until, skip)), index)
        new = best_of_pairs(pairs, centroids, width, k, same)
        new = new if before is None else new.unionByName(before.drop("place"))
        return scratch.written(new.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k), "nearest")

    none = F.transform("low", lambda x: F.lit(None).cast("long"))
    states = anchors.select("aid", "label", "vec", "low", "high", none.alias("kth"))
    best = visited(states, first, 0, None)
    if first >= len(radii):
        return best
    kths = best.filter(F.col("place") == k).groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("of"))
    told = F.transform("low", lambda x, w: F.try_element_at("of", w.cast("long")))
    states = anchors.join(kths, "aid", "left").select("aid", "label", "vec", "low", "high", told.alias("kth"))
    return visited(states, None, first, best)


def whole_part(x: Column) -> Column:
    """x / 100 rounded down, exactly."""
    return F.call_function("div", x - F.pmod(x, F.lit(100).cast("long")), F.lit(100).cast("long"))


def hard_negatives(
    rows: DataFrame, anchor: Column | str, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, lists: int = LISTS, first: int = FIRST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of every row where ``anchor`` holds.

    Components are floor(scale * x), scores integer inner products. An anchor's positives are its first other rows of the same
    label, by score, then by id; the negatives of each are the first rows of another label whose score is from ``low`` to ``high``
    percent of the positive's. The search is exact: rows lie in inverted lists around k-means centroids with their radii, an
    anchor visits lists in the order of their Cauchy-Schwarz bounds, first a few of them, then those whose bound is not
    strictly below its k-th score; lists outside of all windows are never visited. Centroids come from a sample of at most
    ``SAMPLE`` rows and change the work only, not the result.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of unequal lengths are filled
    up with zeros. Null ids are no anchors' by themselves, count as the last of ties and are returned as null; equal ids are
    told apart as rows, so copies of an anchor are among its positives, and a repeated anchor has its rows once for each copy.
    Anchors without a positive, or whose window is empty, have no rows; an empty table gives none. Other columns are not read.
    Components beyond 32 bits or products beyond 62 are refused with an error.
    """
    spark = rows.sparkSession
    bounded(spark)
    marked = fresh(rows, "anchor")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    mine = rows.withColumn(marked, F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False))).filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & sound)
    mine = mine.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(marked).alias("anchor"), F.col(f"`{vector}`").alias("vector"))
    share = min(1.0, SAMPLE / 2 / max(1, rows.count()))
    drawn = mine.select("vector").sample(share, seed=0).limit(SAMPLE).toArrow().column(0).combine_chunks()
    centroids = centroids_of(integers(drawn, scale), lists)
    with Scratch(spark) as scratch:
        all_rows = scratch.written(assigned(mine.select(F.monotonically_increasing_id().alias("uid"), "*"), scale, centroids), "assigned")
        radii = np.full(len(centroids), -1.0)  # a list without rows has no radius
        for r in all_rows.groupBy("list").agg(F.max("distance").alias("radius")).collect():
            radii[r["list"]] = r["radius"]
        index = scratch.written(slices(all_rows), "slices")
        anchors = all_rows.filter("anchor").select(F.col("uid").alias("aid"), F.col("id").alias("anchor_id"), "label", "vec")
        ends = F.array(F.lit(-(2**62))), F.array(F.lit(2**62))
        near = searched(index, anchors.select("*", ends[0].alias("low"), ends[1].alias("high")), centroids, radii, 1, positives, True, scratch, first)
        kept = F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("found")
        windows = near.groupBy("aid").agg(kept).join(anchors, "aid")
        scores = F.transform("found", lambda x: x["score"])
        # Windows that an anchor with fewer positives does not have are empty.
        spare = F.array_repeat(F.lit(0), F.lit(positives) - F.size("found"))
        lows = F.concat(F.transform(scores, lambda p: -whole_part(-low * p)), F.transform(spare, lambda x: F.lit(1).cast("long")))
        highs = F.concat(F.transform(scores, lambda p: whole_part(high * p)), F.transform(spare, lambda x: F.lit(0).cast("long")))
        windows = scratch.written(windows.select("aid", "anchor_id", "label", "vec", "found", lows.alias("low"), highs.alias("high")), "windows")
        far = searched(index, windows, centroids, radii, positives, negatives, False, scratch, first)
        own = windows.select("aid", "anchor_id", F.posexplode("found").alias("w", "positive"))
        out = far.join(own, ["aid", "w"]).select(
            "anchor_id", F.col("positive.id").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
        )
        return written(out, "hard-negatives")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), "vec_id % 100 = 0")
