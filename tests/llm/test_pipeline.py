import corpus_pipeline
import __spark_entry__
from paperloom.llm import decontamination, language
from paperloom.llm.common import written
from tests.conftest import SF
from tests.llm.test_dedup import norm
from tests.llm.test_similarity import roots


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, tell), (_, copies), (_, near), (_, clean), (_, pack) = corpus_pipeline.STAGES
    kept = written(tell(spark, docs, SF), "t")
    learned = language.trained_on(docs)
    told = {r.doc_id for r in docs.collect() if (found := learned.best(r.text))[0] != "und" and found[1] >= language.MARGIN}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == told
    alone = written(copies(spark, kept, SF), "t")
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in alone.collect()} == set(first.values())
    apart = written(near(spark, alone, SF), "t")
    assert {r.doc_id for r in apart.collect()} == set(roots({r.doc_id: r.text or "" for r in alone.orderBy("doc_id").collect()}).values())
    left = written(clean(spark, apart, SF), "t")
    hit = {r.doc_id for r in decontamination.contamination(apart, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in apart.collect()} - hit
    assert {r.doc_id for r in pack(spark, left, SF).collect()} == {r.doc_id for r in left.collect()}


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, written(stage(spark, docs, SF), "t")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before.columns and docs.count() <= before.count()
        ids = {r.doc_id for r in docs.collect()}
        assert ids == {r.doc_id for r in before.collect()} and not ids & {3, 4, 5, 11}
        assert bool(ids) == (table is odd)
