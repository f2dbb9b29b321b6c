"""An inverted-file index over vectors: approximate top-k by cosine, with exact scores of what is found.

Lists belong to k-means centroids of a bounded sample. Every vector is in one list, as one byte a component of what its
centroid leaves over. A search looks at the lists nearest to the query, and the best candidates are scored exactly.
``retrieval.dense_top_k_each`` is the exact way; probing all lists gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import centroids_of, matrix, nearest, same_width, widened
from paperloom.operators.retrieval import cosine

#: Rows of the sample that the centroids are fitted on, at most; on average it has half as many.
SAMPLE = 16_384
#: Vectors of a slice of a list and queries of a tile: what one product holds.
SLICE, TILE = 4096, 512
#: Byte codes of the components go from minus to plus this.
CODES = 127


@dataclass
class Lists:
    """Centroids of unit vectors, and the step of a code in each component."""

    centroids: np.ndarray
    steps: np.ndarray


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and which of them have a direction: no null, no other than finite components, not zero."""
    rows = matrix(column)
    nulls = np.zeros(len(column), bool)
    if column.flatten().null_count:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        nulls = np.bincount(np.repeat(np.arange(len(column)), sizes), weights=column.flatten().is_null().to_numpy(zero_copy_only=False), minlength=len(column)) > 0
    size = np.sqrt((rows**2).sum(1))
    sound = ~nulls & np.isfinite(size) & (size > 0)
    return np.where(sound[:, None], rows, 0.0) / np.where(sound, size, 1.0)[:, None], sound


def fitted(vectors: DataFrame, vec: str = "embedding", lists: int = 64, sample: int = SAMPLE) -> Lists:
    """Centroids from a random sample of at most ``sample`` rows, which is all that the driver sees of the vectors."""
    share = min(1.0, sample / 2 / max(1, vectors.count()))
    drawn = vectors.select(vec).sample(share, seed=0).limit(sample).toArrow().column(0).combine_chunks()
    points, sound = units(drawn)
    points = points[sound]
    centroids = centroids_of(points, lists)
    own, _ = nearest(points, centroids)
    left = np.abs(same_width(points, centroids)[0] - centroids[own]) if len(points) else np.zeros((1, centroids.shape[1]))
    return Lists(centroids, np.maximum(left.max(0), 1e-12) / CODES)


def runs(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows with the same list, the first column, of at most so many rows."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        own = part.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            while a < b:
                if held and (held[0].column(0)[0].as_py() != own[a] or sum(h.num_rows for h in held) >= most):
                    yield pa.Table.from_batches(held)
                    held = []
                take = min(b - a, most - sum(h.num_rows for h in held))
                held.append(part.slice(a, take))
                a += take
    if held:
        yield pa.Table.from_batches(held)


def packed(rows: DataFrame, most: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows ``list, item, data`` of each list in runs of at most ``most``: ``list`` and the columns ``names`` (number, items, data).

    They are dealt out by list and evenly, so a list with very many rows is packed by many tasks.
    """
    count, items, data = names
    kind = rows.schema["item"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(parts, most):
            item = table.column("item").combine_chunks()
            own = pa.ListArray.from_arrays(pa.array([0, len(item)], pa.int32()), item)
            yield pa.RecordBatch.from_arrays([table.column(0)[:1].combine_chunks(), pa.array([len(item)]), own, pa.array([b"".join(table.column("data").to_pylist())], pa.binary())], names=["list", count, items, data])

    dealt = rows.select("list", "item", "data").hint("rebalance", "list").sortWithinPartitions("list", "item")
    return dealt.mapInArrow(run, f"list long, {count} long, {items} array<{kind}>, {data} binary")


def built(vectors: DataFrame, lists: Lists, item: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The index ``list, n, items, codes``: every vector that has a direction, in the list of its nearest centroid, with the
    length of what its codes leave over.

    Vectors without one (null, zero, a component that is null or not finite) are in no list and are never found, as they
    have no cosine. Write it once and search it often.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points, sound = units(part.column(1))
            own, _ = nearest(points, lists.centroids)
            points, middles = same_width(points, lists.centroids)
            steps = np.append(lists.steps, np.full(points.shape[1] - len(lists.steps), 1.0 / CODES))
            codes = np.clip(np.rint((points - middles[own]) / steps), -CODES, CODES).astype(np.int8)
            codes[:, len(lists.steps) :] = 0
            # What the codes leave over bounds the error of every score; rounded up in four bytes.
            left = np.sqrt(((points - middles[own] - codes * steps) ** 2).sum(1)) * (1 + 1e-6)
            data = np.hstack([codes[:, : len(lists.steps)], left.astype("<f4")[:, None].view(np.int8)])
            at = pa.array(np.flatnonzero(sound))
            yield pa.RecordBatch.from_arrays([pa.array(own).take(at), part.column(0).take(at), pa.array([c.tobytes() for c in data], pa.binary()).take(at)], names=["list", "item", "data"])

    kind = vectors.schema[item].dataType.simpleString()
    return packed(vectors.select(item, vec).mapInArrow(run, f"list long, item {kind}, data binary"), SLICE, ("n", "items", "codes"))


def probed(queries: DataFrame, lists: Lists, probes: int) -> DataFrame:
    """``list, n_queries, queries, vectors``: the queries ``query_id, query`` that look at each list, those of their ``probes`` nearest centroids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points, sound = units(part.column(1))
            points, middles = same_width(points, lists.centroids)
            # The centroids with the largest inner products: they have the vectors with the largest cosines.
            near = np.argsort(-(points @ middles.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.flatnonzero(sound), near.shape[1])
            blobs = pa.array([p.astype("<f4").tobytes() for p in points[:, : len(lists.steps)]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near[sound].ravel()), part.column(0).take(pa.array(row)), blobs.take(pa.array(row))], names=["list", "item", "data"])

    kind = queries.schema["query_id"].dataType.simpleString()
    rows = queries.select("query_id", "query").mapInArrow(run, f"list long, item {kind}, data binary")
    return packed(rows, TILE, ("n_queries", "queries", "vectors"))


#: What scores by codes lose in rounding.
SLACK = 1e-6


def candidates(index: DataFrame, queries: DataFrame, lists: Lists, probes: int, keep: int, k: int) -> DataFrame:
    """``query_id, item, score, error``: of each query and each slice that it looks at, the ``keep`` best by their codes, and all
    others that may be among the first ``k``: their scores and errors reach the k-th score less its error."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                row = {name: part.column(name)[at] for name in part.schema.names}
                n, m, own = row["n"].as_py(), row["n_queries"].as_py(), row["list"].as_py()
                stored = np.frombuffer(row["codes"].as_buffer(), np.int8).reshape(n, -1)
                codes, error = stored[:, :-4] * lists.steps, np.ascontiguousarray(stored[:, -4:]).view("<f4")[:, 0].astype(np.float64) + SLACK
                asked = np.frombuffer(row["vectors"].as_buffer(), "<f4").reshape(m, -1).astype(np.float64)
                asked = widened(asked, codes.shape[1])
                scores = np.round(asked @ codes.T + (asked @ lists.centroids[own])[:, None], 9)
                fit = scores >= np.partition(scores, n - keep, axis=1)[:, n - keep, None] if n > keep else np.ones(scores.shape, bool)
                who, where = np.nonzero(fit)  # by query, then by item, as slices are in order of items
                order = np.lexsort((where, -scores[who, where], who))
                who, where = who[order], where[order]
                begins = np.searchsorted(who, np.arange(m))
                first = np.arange(len(who)) - begins[who] < keep  # of equal scores the first items
                fit[:] = False
                fit[who[first], where[first]] = True
                if n > k:
                    fit |= scores + error >= np.partition(scores - error, n - k, axis=1)[:, n - k, None]
                who, where = np.nonzero(fit)
                yield pa.RecordBatch.from_arrays([row["queries"].values.take(pa.array(who)), row["items"].values.take(pa.array(where)), pa.array(scores[who, where]), pa.array(error[where])], names=["query_id", "item", "score", "error"])

    pairs = probed(queries, lists, probes).join(index, "list")
    query, item = pairs.schema["queries"].dataType.elementType.simpleString(), pairs.schema["items"].dataType.elementType.simpleString()
    return pairs.mapInArrow(run, f"query_id {query}, item {item}, score double, error double")


def top_k_each(index: DataFrame, vectors: DataFrame, queries: DataFrame, lists: Lists, k: int, item: str = "vec_id", vec: str = "embedding", probes: int = 32, refine: int = 4) -> DataFrame:
    """``query_id, item, score, rank``: about the ``k`` nearest by cosine of each query ``query_id, query``, ties by item.

    A query looks at ``probes`` lists; the ``refine * k`` best candidates by their codes get exact scores from ``vectors``, and so
    do all others that the errors of the codes do not rule out: what is found is exact among the vectors of these lists.
    Tiles of queries and slices of lists meet by list in one join, whose skewed lists the adaptive planner splits; only
    candidates are shuffled again. Queries without a direction find nothing. Scores count to twelve digits, as in the exact search.
    """
    keep = refine * k
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    own, low = Window.partitionBy("query_id"), F.col("score") - F.col("error")
    found = candidates(index, queries, lists, probes, keep, k).withColumn("rank", F.row_number().over(w)).withColumn("place", F.row_number().over(own.orderBy(F.desc(low))))
    found = found.withColumn("kth", F.max(F.when(F.col("place") == k, low)).over(own)).filter((F.col("rank") <= keep) | F.col("kth").isNull() | (F.col("score") + F.col("error") >= F.col("kth")))
    exact = found.select("query_id", F.col("item").alias(item)).join(vectors.select(item, vec), item).join(queries.select("query_id", "query"), "query_id")
    scored = exact.select("query_id", item, F.round(cosine(F.col(vec), F.col("query")), 12).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, item: str = "vec_id") -> DataFrame:
    """``query_id, recall``: the share of each query's exact hits that were found."""
    hit = found.select("query_id", item, F.lit(1.0).alias("hit"))
    return exact.join(hit, ["query_id", item], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
