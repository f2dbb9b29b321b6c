"""Positional joins against zip."""

import random
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from paperloom.operators import positions as ps


@pytest.mark.parametrize(("n", "m"), [(500, 500), (300, 310), (40, 0), (0, 0)])
def test_zip_by_position(spark, n, m):
    rng = random.Random(n + m)
    a, b = rng.sample(range(10_000), n), rng.sample(range(10_000), m)
    asked = spark.createDataFrame([(x,) for x in a], "x long").repartition(5)
    answers = spark.createDataFrame([(y, f"a{y}") for y in b], "y long, label string").repartition(3)
    got = ps.zipped(asked, ["x"], answers, [F.desc("y")]).select("x", "label").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(zip_longest(sorted(a), [f"a{y}" for y in sorted(b, reverse=True)]), key=repr)
    assert sorted(r.ordinal for r in ps.numbered(asked, "x").collect()) == list(range(n))


def test_zip_within_pages(spark):
    lines = spark.createDataFrame([(1, 0, 5), (1, 0, 2), (1, 1, 1), (2, 0, 9)], "doc_id long, page int, line_no int")
    told = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 1, 0, "c")], "doc_id long, page int, k int, label string")
    got = ps.zipped_in_groups(lines, told, ["doc_id", "page"], ["line_no"], ["k"]).select("doc_id", "page", "line_no", "label").collect()
    assert {tuple(r) for r in got} == {(1, 0, 2, "a"), (1, 0, 5, "b"), (1, 1, 1, "c"), (2, 0, 9, None)}
