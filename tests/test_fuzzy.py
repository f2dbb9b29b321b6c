"""The fuzzy join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import noise as nz
from paperloom.plans import adapters as ad
from paperloom.plans import registry
from tests.conftest import SF


def all_pairs(left, right, least):
    return sorted((i, a, b) for i, a in left for j, b in right if i == j and nz.indel_ratio(a, b) > least)


def edited(rng, text, most):
    out = list(text)
    for _ in range(rng.randrange(most)):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and at < len(out):
            del out[at]
        else:
            out.insert(at, rng.choice("abc d"))
    return "".join(out)


@pytest.mark.parametrize(("seed", "least"), [(1, 90.0), (2, 90.0), (3, 92.5), (4, 96.0)])
def test_fuzzy_join_loses_no_pair(spark, seed, least):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc d") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 5, 6, 7, 9, 12, 20, 21, 40, 80, 120)]
    left = {(rng.randrange(2), edited(rng, rng.choice(base), 9)) for _ in range(300)}
    right = {(rng.randrange(2), edited(rng, rng.choice(base), 9)) for _ in range(300)} | {(0, b) for b in base}
    got = nz.fuzzy_pairs(spark.createDataFrame(sorted(left), "g long, a string"), spark.createDataFrame(sorted(right), "g long, b string"), ["g"], least)
    assert sorted((r.g, r.a, r.b) for r in got.collect()) == all_pairs(left, right, least)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 900])
def test_large_groups_give_the_same_pairs(spark, monkeypatch, most):
    """Groups with more characters than a task takes go by their runs."""
    monkeypatch.setattr(nz, "IN_TASK", most)
    test_fuzzy_join_loses_no_pair(spark, 5, 90.0)


def test_runs_of_small_groups_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "some line of text"), (1, "some line of texts"), (None, "x"), (2, None)], "g long, a string")
    got = nz.fuzzy_pairs(df, df.withColumnRenamed("a", "b"), ["g"])
    assert got.count() == 4
    assert "gram" not in got._jdf.queryExecution().executedPlan().toString()


def test_low_ratios_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "g long, a string")
    with pytest.raises(ValueError, match="need not share"):
        nz.fuzzy_pairs(df, df.withColumnRenamed("a", "b"), ["g"], 70.0)


def test_near_copies_of_lines_are_those_of_all_pairs(spark):
    lines = {(r.doc_id, r.text) for r in ad.lines(spark, SF).filter("doc_id < 60").select("doc_id", F.col("text")).collect()}
    want = [x for x in all_pairs(lines, lines, 90.0) if x[1] < x[2]]
    got = registry.queries()["near_copy_indel"](spark, SF).filter("doc_id < 60").collect()
    assert sorted((r.doc_id, r.a, r.b) for r in got) == want
