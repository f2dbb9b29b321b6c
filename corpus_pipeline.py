"""A corpus pipeline over the documents table: each stage is one training-data operator and keeps what passes it.

Stages get the documents that their predecessor kept, with all columns. In each of them null texts count as empty, ids may
be null or repeat, every row is judged by itself, very long texts are taken whole, an empty table stays empty, and names of
other columns may clash with any used inside. Ties: of equal languages none is told apart, so the document goes; of copies
and near copies the least doc_id stays, null ids last, then the first row. The last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontamination, exact_dedup, language, packing, similarity
from paperloom.llm.common import Scratch, documents
from paperloom.llm.tokens import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told."""
    return language.accepted(docs, language.trained_on(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a similarity of 0.8 or more of five-word shingles.

    Fingerprints are compared at the anchors of a covering code, as in ``simhash``, and what they find is verified on whole sets
    of shingles. Fingerprints within a few bits do not tell that similarity (README), so the documents that are not joined by
    then get an exact search for the rest: a shingle of a prefix that no similar pair can miss.
    """
    return similarity.similar_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Language identification, fingerprints and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = documents(spark, sf_dir), Scratch(spark)
    *stages, (_, last) = STAGES
    for name, stage in stages:
        before, docs = docs, kept.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.drop(before)  # a stage's table goes once the next one is written; the last is what the result reads
    return last(spark, docs, sf_dir)
