"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, written


def star_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``, where ``root`` is the least node of its component.

    Alternating large-star and small-star steps: every step is one minimum per node (summed up before the shuffle) and
    one join. The minimums are written before the join: an aggregate right under it would keep the adaptive planner from
    splitting a node with very many links. The number of steps grows with the logarithm of a component's length. Each
    step is written to the shared folder, so no lineage builds up, and the one before it is removed.
    """
    with Scratch(links.sparkSession) as held:
        edges = held.written(_pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
        before = None
        while (now := _signature(edges)) != before:
            before = now
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = held.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
            large = _pairs(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
            large = held.written(large, "links")
            held.drop(edges, least)
            least = held.written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
            edges = held.written(_pairs(small), "links")
            held.drop(large, least)
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return written(roots, "components")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
