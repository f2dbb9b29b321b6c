import random

import corpus_pipeline
from paperloom.llm import similarity
from paperloom.llm.common import written
from tests.conftest import SF


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def roots(texts):
    """Components of all pairs that share 0.8 or more of their five-word shingles."""
    ids, sets, parent = list(texts), {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_pairs_of_any_fingerprint_distance_link(spark):
    random.seed(3)
    word = lambda: f"w{random.randrange(500)}"
    line = " ".join(word() for _ in range(12))
    base = [word() for _ in range(120)]
    texts = {}
    for k in range(260):
        own = list(base) if k < 150 else [word() for _ in range(random.randint(1, 90))]
        for _ in range(random.randint(0, 4)):
            own[random.randrange(len(own))] = word()
        texts[k] = " ".join(own) + (f" {line}" if k % 3 == 0 else "")
    for k in range(260, 300):
        own = texts[random.randrange(150, 260)].split()
        own[random.randrange(len(own))] = word()
        texts[k] = " ".join(own)
    want = roots(texts)
    assert len(set(want.values())) < 299 and sum(want[k] == 0 for k in range(150)) > similarity.SMALL
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    path = written(table, "t")
    assert {r.doc_id: r.component_id for r in similarity.similar_groups(path).collect()} == want


def test_near_stage_leaves_no_similar_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.orderBy("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()}
    assert kept == set(roots(texts).values())


def test_anchors_find_links_first(spark, monkeypatch):
    """Fingerprints at anchors link long copies with one word changed; the search for the rest gets what is not joined then."""
    random.seed(5)
    words = [[f"w{random.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    texts = {2 * k: " ".join(own) for k, own in enumerate(words)} | {2 * k + 1: " ".join([*own[:-1], "changed"]) for k, own in enumerate(words)}
    found, rest = [], []
    anchors, unlinked = similarity.anchored, similarity.unlinked

    def kept(to, call):
        def run(*given):
            to.append(written(call(*given), "t"))
            return to[-1]

        return run

    monkeypatch.setattr(similarity, "anchored", kept(found, anchors))
    monkeypatch.setattr(similarity, "unlinked", kept(rest, unlinked))
    table = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "t")
    assert {r.doc_id: r.component_id for r in similarity.similar_groups(table).collect()} == roots(texts)
    assert found[0].count() > 20 and found[0].count() + rest[0].count() == 30


def test_odd_rows(odd, empty):
    got = similarity.similar_groups(odd).collect()
    assert len(got) == odd.count() and len({r.component_id for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert similarity.similar_dedup(odd).columns == odd.columns
    assert similarity.similar_groups(empty).count() == similarity.similar_dedup(empty).count() == 0
