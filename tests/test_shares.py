"""Shares of a bounded number of rows."""

from pyspark.sql import functions as F

from paperloom.operators import shares
from paperloom.plans import adapters as ad
from paperloom.plans import edit_queries as eq


def test_shares_do_not_grow_with_the_table(spark):
    """Ten times the rows make ten times the shares; a key's rows stay in one, and a join by the key and more moves nothing again."""
    largest = {}
    for n in (40_000, 400_000):
        rows = shares.shared_out(spark.range(n).select((F.col("id") / 4).cast("long").alias("k"), "id"), "k", size=5_000)
        dealt = rows.groupBy(F.spark_partition_id().alias("share")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"))
        largest[n], keys = dealt.agg(F.max("n")).first()[0], dealt.agg(F.sum("keys")).first()[0]
        assert keys == n / 4
    assert largest[400_000] < 1.5 * largest[40_000] < 15_000


def test_boxes_come_in_shares(spark, monkeypatch):
    monkeypatch.setattr(shares, "ROWS", 500)
    for side in ad.boxes(spark, "/root/testdata/sf0.001", dealt=True):
        assert side.rdd.getNumPartitions() >= 12


def test_boxes_of_every_query_come_in_shares(spark, monkeypatch):
    monkeypatch.setattr(shares, "ROWS", 500)
    for side in ad.boxes(spark, "/root/testdata/sf0.001"):
        assert side.rdd.getNumPartitions() >= 12


def test_words_come_in_shares_and_move_as_texts(spark, monkeypatch):
    """Documents are dealt out by their words, before they are cut into these; spans are made without another shuffle."""
    monkeypatch.setattr(eq, "WORDS", 5_000, raising=False)
    words = eq.tagged_words(spark, "/root/testdata/sf0.001")
    assert words.rdd.getNumPartitions() == -(-words.count() // 5_000) > 4
    plan = eq.spans_formatted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("Exchange ")


def test_shares_of_rows_that_become_many(spark):
    rows = spark.range(10).select("id", F.when(F.col("id") > 0, 100 * F.col("id")).alias("n"))
    assert shares.shares(rows, 90, F.col("n")) == 50 and shares.shares(rows, 90) == shares.shares(rows.limit(0), 90, F.col("n")) == 4
