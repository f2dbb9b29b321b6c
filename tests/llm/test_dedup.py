import hashlib
import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import exact_dedup as ed
from paperloom.llm import graph
from paperloom.llm import simhash as sh
from tests.conftest import SF
from tests.llm.conftest import rows


@given(st.text(" \t\n\x0b\x0c\rab\x1c ", max_size=12))
def test_squeezed(text):
    assert ed.squeezed(text.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()


@given(st.lists(st.text("abc", max_size=3), max_size=60), st.integers(1, 2000))
def test_grace_groups_whatever_fits(texts, table_bytes):
    got = {c: sorted(k for (k,) in members) for c, members in ed.grace([(t.encode(), (k,)) for k, t in enumerate(texts)], table_bytes)}
    want = defaultdict(list)
    for k, t in enumerate(texts):
        want[t.encode()].append(k)
    assert got == want


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_of_odd_rows(odd):
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        want += [(i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    for table_bytes in (ed.TABLE_BYTES, 300):
        got = [tuple(r)[1:] for r in ed.exact_groups(odd, table_bytes=table_bytes).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_keeps_columns(odd, empty):
    kept = ed.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({norm(r[1]) for r in rows()})
    assert ed.exact_dedup(empty).count() == ed.exact_groups(empty).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_that_of_spark(spark):
    assert sh.fingerprint(b"a b c d") == spark.sql("SELECT xxhash64('a b c d')").first()[0] % 2**64


def components(fps):
    ids, parent = list(fps), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op5_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op5_simhash(spark, SF).collect()}
    assert got == {i: (format(fps[i], "016x"), want[i]) for i in texts}


def test_near_links_lose_nothing(spark):
    import random

    random.seed(5)
    fps = {random.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for _ in range(3):
            g = f
            for b in random.sample(range(64), random.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = components({signed(f): f for f in fps})
    for blocks, tile in ((3, 20_000), (2, 20_000), (3, 2)):
        roots = {r.node: r.root for r in graph.star_components(sh.near_links(table, blocks=blocks, tile=tile)).collect()}
        for f in fps:
            same = {x for x in want if want[x] == want[signed(f)]}
            assert roots.get(signed(f), signed(f)) == min(same)


def test_clusters_are_those_of_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    fps = np.concatenate([np.uint64(2**40) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), rng.integers(0, 2**63, 200).astype(np.uint64)])
    a, b = sh.links_of(np.zeros(len(fps), np.int64), fps, 4)
    want = components({int(f): int(f) for f in set(fps.tolist())})
    linked = {x for x in want if sum(want[x] == want[y] for y in want) > 1}
    assert set(a.tolist()) | set(b.tolist()) == {x - 2**64 if x >= 2**63 else x for x in linked}


def test_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in graph.star_components(links).collect()}
    assert roots == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_near_groups_of_odd_rows(odd, empty):
    got = sh.near_groups(odd).collect()
    assert len(got) == len(rows())
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    assert sum(r.kept for r in zero) == 1
    assert len({r.component_id for r in got if r.doc_id in (8, 9)}) == 1
    assert sh.near_dedup(odd).columns == odd.columns
    assert sh.near_groups(empty).count() == sh.near_dedup(empty).count() == 0


def test_inputs_that_are_no_scans(spark, odd):
    """Rows whose plan deals them out anew are written before they are numbered."""
    from paperloom.llm import common

    assert common.stable(odd) is odd and common.stable(odd.filter("doc_id > 3").select("text")) is not None
    mixed = odd.repartition(5).orderBy("text").limit(100)
    assert common.stable(mixed) is not mixed
    assert sorted(map(repr, ed.exact_dedup(mixed).select("text").collect())) == sorted({repr(r) for r in ed.exact_dedup(mixed).select("text").collect()})
    assert ed.exact_dedup(mixed).count() == ed.exact_dedup(odd).count() == len({norm(r[1]) for r in rows()})
