"""The inverted file and the posting blocks against exact searches."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import retrieval as rt
from paperloom.operators import vector_index as vi
from paperloom.plans import queries, registry

SMALL = "/root/testdata/sf0.01"


def asked(vectors):
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_recall_of_the_inverted_file(spark):
    """At least nine in ten of the exact first ten are found with 40 of 64 lists, and all of them with all lists."""
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    lists = vi.fitted(vectors)
    index = vi.built(vectors, lists).cache()
    assert index.agg(F.sum("n")).first()[0] == vectors.count()
    exact = rt.dense_top_k_each(vectors, asked(vectors), 10).cache()
    some = vi.top_k_each(index, vectors, asked(vectors), lists, 10, probes=40, refine=2)
    assert vi.recall(some, exact).agg(F.avg("recall")).first()[0] >= 0.9
    whole = vi.top_k_each(index, vectors, asked(vectors), lists, 10, probes=64, refine=8)
    assert vi.recall(whole, exact).agg(F.min("recall")).first()[0] == 1.0


def test_inverted_file_of_clusters_reads_few_lists(spark):
    """Where vectors are in clusters, one list in eight holds the neighbours."""
    rng = random.Random(1)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(k, [x + rng.gauss(0, 0.1) for x in rng.choice(middles)]) for k in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    lists = vi.fitted(vectors, lists=32)
    found = vi.top_k_each(vi.built(vectors, lists), vectors, asked(vectors), lists, 10, probes=4)
    exact = rt.dense_top_k_each(vectors, asked(vectors), 10)
    assert vi.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.95


def test_vectors_without_direction_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(vi, "SLICE", 50)
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 0.0]), (20, [1.0, 1.0]), (40, None)]
    rows += [(1000 + k, [3.0, 3.0]) for k in range(400)] + [(2000 + k, [k + 1.0, 1.0]) for k in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).cache()
    lists = vi.fitted(vectors, lists=4)
    got = vi.top_k_each(vi.built(vectors, lists), vectors, asked(vectors), lists, 5, probes=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got if r.query_id == 20] == [(20, i) for i in (20, 1000, 1001, 1002, 1003)]
    assert {r.query_id for r in got} == {20, *range(1000, 1400, 20), *range(2000, 2050, 20)}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    lists = vi.fitted(none)
    assert vi.top_k_each(vi.built(none, lists), none, asked(none), lists, 5).collect() == []


def test_near_copies_are_told_apart(spark):
    """Of many vectors that differ by less than a step of the codes, the index finds the same as the exact search."""
    rng = random.Random(4)
    draw = lambda: [rng.gauss(0, 1) for _ in range(16)]
    middle = draw()
    rows = [draw() for _ in range(500)] + [[x + rng.gauss(0, 1e-4) for x in middle] for _ in range(600)]
    rng.shuffle(rows)
    vectors = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3).cache()
    lists = vi.fitted(vectors, lists=8)
    got = vi.top_k_each(vi.built(vectors, lists), vectors, asked(vectors), lists, 5, probes=8, refine=2)
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert rows_of(got) == rows_of(rt.dense_top_k_each(vectors, asked(vectors), 5))


def test_products_of_a_batch_are_bounded(spark, monkeypatch):
    """A batch of vectors is held against the queries some rows at a time, with the same hits."""
    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(3)) for _ in range(3)] if k % 9 else None, k % 2) for k in range(500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2).cache()
    hits = lambda: sorted(tuple(r) for r in rt.dense_top_k_each(vectors, asked(vectors), 4, by="label").collect())
    whole = hits()
    monkeypatch.setattr(rt, "ROWS", 7)
    assert hits() == whole and len(whole) > 100


@pytest.mark.parametrize(("seed", "size", "k"), [(1, 4, 3), (2, 7, 10), (3, 256, 5), (4, 3, 1)])
def test_posting_blocks_lose_nothing(spark, seed, size, k):
    rng = random.Random(seed)
    terms = ["hot", "warm", "mild", "rare", "lone"]
    share = dict(zip(terms, (0.9, 0.6, 0.3, 0.05, 0.01), strict=True))
    rows = [(t, d, float(rng.choice((1, 1, 1, 2, 3, 9)))) for d in range(400) for t in terms if rng.random() < share[t]]
    index = spark.createDataFrame(rows, "term string, doc_id long, weight double").cache()
    queries = spark.createDataFrame([(q, t, rng.choice((0.5, 1.0, 2.0, 8.0))) for q in range(12) for t in rng.sample(terms, rng.randrange(1, 5))] + [(50, "unknown", 1.0)], "query_id long, term string, weight double").cache()
    blocks = rt.posting_blocks(index, size=size).cache()
    assert blocks.agg(F.sum("n")).first()[0] == len(rows)
    want = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in rt.sparse_top_k_each(index, queries, k).collect()}
    got = {(r.query_id, r["rank"]): (r["item"], round(r.score, 9)) for r in rt.sparse_top_k_blocks(blocks, queries, k).collect()}
    assert got == want
    read = rt.postings_read(rt.block_plan(blocks, queries, k)[0]).agg(F.sum("n_all").alias("a"), F.sum("n_read").alias("r")).first()
    assert read.r < read.a or k == 10


def test_routes_of_many_questions_are_those_of_one(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d"]
    asked = [(k, rng.choice(["compare", "fact", "structured", "other"]), rng.choices(names, k=rng.randrange(4)), rng.sample(names, rng.randrange(3))) for k in range(60)]
    got = {r.query_id: (r.kind, r.kept) for r in rt.routes(spark.createDataFrame(asked, "query_id long, intent string, entities array<string>, only array<string>"), most=3).collect()}
    assert got == {k: rt.routed(intent, entities, only, most=3) for k, intent, entities, only in asked}


def test_equal_questions_are_one_search_with_a_bound(spark):
    """The same items are the best for all terms, so a bound needs more postings than ``k``; what is read stays far below all of them."""
    rng = random.Random(8)
    rows = [(t, d, float(w * (1 + d % 3))) for d in range(3000) for w in [1 + 400 // (d + 1)] for t in "abcd"]
    index = spark.createDataFrame(rows, "term string, doc_id long, weight double").cache()
    asked = [[(t, float(4 - k)) for k, t in enumerate(rng.sample("abcd", 4))] for _ in range(3)]
    queries = spark.createDataFrame([(q, t, w) for q in range(30) for t, w in asked[q % 3]], "query_id long, term string, weight double").cache()
    blocks = rt.posting_blocks(index, size=16).cache()
    assert rt.asked_once(queries).select("asked").distinct().count() == 3
    read = rt.postings_read(rt.block_plan(blocks, queries, 5)[0]).agg(F.sum("n_all").alias("a"), F.sum("n_read").alias("r")).first()
    assert read.r * 20 < read.a
    want = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in rt.sparse_top_k_each(index, queries, 5).collect()}
    assert {(r.query_id, r["rank"]): (r["item"], r.score) for r in rt.sparse_top_k_blocks(blocks, queries, 5).collect()} == want


@pytest.mark.parametrize(("rows", "found"), [(131_072, 2_000_000), (5, 20)])
def test_counted_items_give_the_same_as_postings(spark, monkeypatch, rows, found):
    """Also with null and repeated ids, texts without words, and in small blocks."""
    monkeypatch.setattr(rt, "ASKED", rows)
    monkeypatch.setattr(rt, "FOUND", found)
    monkeypatch.setattr(rt, "DOCS", 90)
    monkeypatch.setattr(rt, "TERMS", found)
    rng = random.Random(11)
    words = [f"w{c}" for c in "abcdefghijkl"]
    docs = [(rng.choice([k, k, k, 7, None]), " ".join(rng.choices(words, range(1, 13), k=rng.randrange(12))).upper()) for k in range(500)] + [(900, None), (901, ""), (902, "12 é!"), (-5, "WA,wb\nWc")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).cache()
    index = rt.sparse_index(docs, F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: x != "")).cache()
    queries = spark.createDataFrame([(q, t, rng.choice((0.5, 1.0, 4.0))) for q in range(25) for t in rng.sample([*words, "none"], rng.randrange(1, 5))], "query_id long, term string, weight double").cache()
    counted = rt.counted_terms(docs, F.lower("text")).cache()
    rows_of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows_of(counted.select("doc_id", F.explode(F.split("terms", " ")).alias("term"))) == rows_of(index.select("doc_id", "term"))
    want = rows_of(rt.sparse_top_k_each(index, queries, 6).select("query_id", "doc_id", "score", "rank"))
    assert rows_of(rt.sparse_top_k_counted(counted, queries, 6).select("query_id", "doc_id", "score", "rank")) == want and len(want) > 100
    assert rt.sparse_top_k_counted(counted, queries.limit(0), 6).collect() == rt.sparse_top_k_counted(counted.limit(0), queries, 6).collect() == []


def test_pairs_of_queries_and_items_in_pieces(monkeypatch):
    rng = random.Random(12)
    own = [{t: rng.randrange(1, 9) for t in rng.sample("abcdef", rng.randrange(1, 6))} for _ in range(60)]
    asked = [(t, q, float(rng.randrange(1, 4))) for t in "abd" for q in range(4) if rng.random() < 0.7]
    starts = np.searchsorted([t for t, _, _ in asked], ["a", "b", "d", "e"])
    columns = pa.array([" ".join(d) for d in own]), pa.array([np.array([*d.values()], "<i4").tobytes() for d in own]), pa.array(["a", "b", "d"]), starts, np.array([q for _, q, _ in asked]), np.array([w for _, _, w in asked])
    want = {}
    for row, d in enumerate(own):
        for t, q, w in asked:
            if t in d:
                want[q, row] = want.get((q, row), 0) + w * d[t]
    for pairs in (1_000_000, 7, 1):
        monkeypatch.setattr(rt, "PAIRS", pairs)
        pieces = list(rt.paired(*columns, 4))
        assert {(q, row): s for piece in pieces for q, row, s in zip(*(x.tolist() for x in piece), strict=True)} == want
        assert sum(len(q) for q, _, _ in pieces) == len(want) and (len(pieces) == 1) == (pairs > 1000)


def test_hybrid_search_does_not_move_every_pair(spark, tmp_path):
    """Where all documents ask for the same words, each query and each document are a pair; only the best of a task are shuffled."""
    spark.range(1200).selectExpr("id AS doc_id", "concat('rare words stay here ', repeat('rare ', int(id % 9))) AS text").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "embeddings.parquet").symlink_to("/root/testdata/sf0.001/embeddings.parquet")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before, con = shuffled(), duckdb.connect()
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as if the tables were large
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        got = sorted(tuple(r) for r in queries.search_hybrid_rrf(spark, str(tmp_path)).collect())
    finally:
        for key in small:
            spark.conf.unset(key)
    assert shuffled() - before < 60 * 1200 / 2
    for name, path in (("documents", "documents.parquet/*.parquet"), ("embeddings", "embeddings.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{path}'")
    assert got == sorted(con.execute(registry.oracle_sql()["search_hybrid_rrf"]).fetchall())
