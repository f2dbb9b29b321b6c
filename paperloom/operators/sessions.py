"""Chat sessions: context windows, orphans, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import clean_title, filled, first_json_object


def last_turns(messages: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def without_orphans(messages: DataFrame) -> DataFrame:
    """Messages up to the last one that is not the user's: a question without an answer is not sent again."""
    w = Window.partitionBy("conv_id")
    answered = F.max(F.when(F.col("role") != "user", F.col("turn"))).over(w)
    return messages.withColumn("_last", answered).filter(F.col("turn") <= F.col("_last")).drop("_last")


def titles(messages: DataFrame, most: int = 20) -> DataFrame:
    """``conv_id, title`` from the first question; a fallback where there is none."""
    first = messages.groupBy("conv_id").agg(F.min_by("text", "turn").alias("any"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
    return first.select("conv_id", F.coalesce(filled(clean_title("question", most)), F.lit("untitled")).alias("title"))


def normalised_plans(rows: DataFrame) -> DataFrame:
    """``conv_id, intent, rewrites`` from free text with a JSON object: unknown intents are ``fact``, ``rank`` is
    ``structured``, empty rewrites fall away, and without any the query stands for them."""
    plan = F.from_json(first_json_object("answer"), "intent string, rewrites array<string>", {"mode": "PERMISSIVE"})
    intent = F.lower(F.trim(F.col("p.intent")))
    known = F.when(intent == "rank", "structured").when(intent.isin("fact", "compare", "structured"), intent).otherwise("fact")
    kept = F.filter(F.transform(F.coalesce("p.rewrites", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("p", plan).select("conv_id", known.alias("intent"), F.when(F.size(kept) == 0, F.array("query")).otherwise(kept).alias("rewrites"))
