import random

import pytest

from paperloom.operators import attributes as at
from paperloom.plans import registry
from tests.conftest import SF, compare


def test_names_resolve_beyond_a_thousand(spark):
    known = spark.createDataFrame([(f"p{k:05}x",) for k in range(3000)] + [("ends a",), ("a first",), ("",), (None,)], "project string")
    names = [f"p{k:05}x" for k in range(3000)] + [" p02999 ", "p0299", "a", "", "zz", None]
    got = {r.name: r.project for r in at.uniquely_resolved(spark.createDataFrame([(n,) for n in names], "name string"), known).collect()}
    want = {f"p{k:05}x": f"p{k:05}x" for k in range(3000)} | {" p02999 ": "p02999x", "p0299": None, "a": "ends a", "": None, "zz": None, None: None}
    assert got == want


def test_resolve_query_equals_sql(spark, duck):
    compare(registry.queries()["entity_resolve_unique"](spark, SF), duck, registry.oracle_sql()["entity_resolve_unique"])


@pytest.mark.parametrize("seed", range(3))
def test_containment_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choice("abAé中 ") for _ in range(rng.randrange(most)))
    parts, wholes = {word(6) for _ in range(150)}, {word(12) for _ in range(150)}
    got = at.held_in(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((p, w) for p in parts for w in wholes if p and p in w)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_greedy_resolution_is_the_nested_loop(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abC ") for _ in range(rng.randrange(5)))
    known = list(dict.fromkeys(word() for _ in range(25)))
    groups = [(g, [word() for _ in range(rng.randrange(1, 6))]) for g in range(30)]
    got = at.greedily_resolved(spark.createDataFrame(groups, "group_id long, names array<string>"), spark.createDataFrame([(p, k) for k, p in enumerate(known)], "project string, pos long"))
    want = []
    for g, names in groups:
        used = set()
        for idx, name in enumerate(names):
            m = "".join(name.split()).lower()
            hit = next((p for p in known if m and p not in used and (m in (k := "".join(p.split()).lower()) or k in m)), None)
            used.add(hit)
            want.append((g, idx, hit))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
