"""Joins in tiles against all pairs of a page."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.geometry import Box
from paperloom.operators import layout as ly
from paperloom.operators import tiles

SCHEMA = "doc_id long, page int, {} long, x0 double, y0 double, x1 double, y1 double"


def drawn(rng, n, number, wide=False):
    rows = []
    for k in range(n):
        x, y = rng.randrange(1000), rng.randrange(1000)
        w, h = (rng.randrange(900), rng.randrange(900)) if wide and k % 50 == 0 else (rng.randrange(40), rng.randrange(30))
        rows.append((1 + k % 2, k % 3, k, float(x), float(y), float(x + w), float(y + h)))
    rows += [(9, 0, 0, 5.0, 5.0, 5.0, 5.0), (9, 0, 1, 0.0, 0.0, 10.0, 10.0), (8, 0, 0, None, 1.0, 2.0, 3.0)]
    return rows, SCHEMA.format(number)


def page_pairs(a, b):
    return [(p, q) for p in a for q in b if p[:2] == q[:2] and None not in (p[3], q[3])]


@pytest.mark.parametrize(("seed", "n"), [(1, 30), (2, 900), (3, 2500)])
def test_meeting_pairs_are_those_of_all_pairs(spark, seed, n):
    rng = random.Random(seed)
    (a, sa), (b, sb) = drawn(rng, n, "line_no", wide=True), drawn(rng, n, "block_no", wide=True)
    lines, blocks = spark.createDataFrame(a, sa), spark.createDataFrame(b, sb)
    got = tiles.meeting_pairs(ly.side(lines, "a_", "line_no"), ly.side(blocks, "b_", "block_no"))
    want = sorted((p[0], p[1], p[2], q[2]) for p, q in page_pairs(a, b) if p[3] < q[5] and q[3] < p[5] and p[4] < q[6] and q[4] < p[6])
    assert sorted(tuple(r) for r in got.select("doc_id", "page", "a_id", "b_id").collect()) == want


def test_few_pairs_are_looked_at(spark):
    """On a crowded page the pairs that share a cell are a few times the true ones, where all pairs are hundreds of times."""
    rng = random.Random(5)
    rows = [(1, 0, k, float(x), float(y), x + 9.0, y + 9.0) for k, (x, y) in enumerate((rng.randrange(2000), rng.randrange(2000)) for _ in range(8000))]
    blocks = spark.createDataFrame(rows, SCHEMA.format("block_no"))
    a, b = ly.side(blocks, "a_", "block_no"), ly.side(blocks, "b_", "block_no")
    cells = tiles.grid(a, b)
    own = Box.of("a_")
    dealt = tiles.spread(a.join(cells, tiles.PAGE), (tiles.cell(own.x0, "g_x", "g_w"), tiles.cell(own.x1, "g_x", "g_w")), (tiles.cell(own.y0, "g_y", "g_h"), tiles.cell(own.y1, "g_y", "g_h")))
    looked = dealt.groupBy("cell_x", "cell_y").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    true = tiles.meeting_pairs(a, b).count()
    assert looked < 12 * true < len(rows) ** 2 / 20


@pytest.mark.parametrize(("seed", "n"), [(1, 30), (2, 900), (3, 2500)])
def test_nearest_is_that_of_all_pairs(spark, seed, n):
    rng = random.Random(seed)
    (a, sa), (b, sb) = drawn(rng, n // 4, "ref_no"), drawn(rng, n, "block_no")
    a += [(1, 0, 5000 + k, 9000.0 + k, 9000.0, 9001.0 + k, 9001.0) for k in range(3)]  # far from everything
    points, blocks = spark.createDataFrame(a, sa), spark.createDataFrame(b, sb)
    corner = {}
    for p, q in page_pairs(a, b):
        far = ((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) ** 0.5
        corner[p[:3]] = min(corner.get(p[:3], (float("inf"), 0)), (far, q[2]))
    got = {(r.doc_id, r.page, r.ref_no): r.block_no for r in ly.nearest_corner(points, blocks).collect()}
    assert got == {k: v[1] for k, v in corner.items()}
    lines = points.withColumnRenamed("ref_no", "line_no")
    overlapping = {(r.doc_id, r.page, r.line_no) for r in ly.largest_overlap(lines, blocks).collect()}
    near = {}
    for p, q in page_pairs(a, b):
        dx, dy = (p[3] + p[5]) / 2 - (q[3] + q[5]) / 2, (p[4] + p[6]) / 2 - (q[4] + q[6]) / 2
        near[p[:3]] = min(near.get(p[:3], (float("inf"), 0)), ((dx * dx * 5 + dy * dy) ** 0.5, q[2]))
    got = {(r.doc_id, r.page, r.line_no): r.block_no for r in ly.nearest_block(lines, blocks).collect()}
    assert got == {p[:3]: near[p[:3]][1] if p[:3] in near and near[p[:3]][0] < 20 else None for p in a if p[:3] not in overlapping}


def test_boxes_with_nothing_to_be_near_to(spark):
    """A box without a corner, one of a page without others and one without a page have nothing near; none is lost."""
    a = [(1, 0, 0, 1.0, 1.0, 2.0, 2.0), (1, 0, 1, None, 1.0, 2.0, 2.0), (2, 0, 2, 1.0, 1.0, 2.0, 2.0), (3, None, 3, 1.0, 1.0, 2.0, 2.0)]
    b = [(1, 0, 7, 5.0, 5.0, 6.0, 6.0), (1, 0, 6, 5.0, 5.0, 6.0, 6.0), (3, None, 8, 1.0, 1.0, 2.0, 2.0)]
    lines, blocks = spark.createDataFrame(a, SCHEMA.format("line_no")), spark.createDataFrame(b, SCHEMA.format("block_no"))
    got = tiles.nearest(ly.side(lines, "a_", "line_no"), ly.side(blocks, "b_", "block_no"), lambda p, q: p.center_distance(q), F.least)
    assert {r.a_id: r.b_id for r in got.collect()} == {0: 6, 1: None, 2: None, 3: None}
    assert tiles.meeting_pairs(ly.side(lines, "a_", "line_no"), ly.side(lines, "b_", "line_no")).count() == 2
    assert {r.line_no: r.block_no for r in ly.nearest_block(lines, blocks).collect()} == {0: 6, 1: None, 2: None, 3: None}


def test_sides_are_not_joined_to_their_grid(spark):
    blocks = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("block_no"), *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 9.0), ("y1", 9.0))))
    plan = tiles.meeting_pairs(ly.side(blocks, "a_", "block_no"), ly.side(blocks, "b_", "block_no"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
