"""The queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import alignment, bpe, decontamination, exact_dedup, hard_negatives, language, licenses, lm, packing, sharding, simhash, token_store, warc

import corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_packing": packing.op3_packing,
        "op4_language": language.op4_language,
        "op5_simhash": simhash.op5_simhash,
        "op6_token_store": token_store.op6_token_store,
        "op7_warc": warc.op7_warc,
        "op8_sharding": sharding.op8_sharding,
        "op9_licenses": licenses.op9_licenses,
        "op10_lm_scoring": lm.op10_lm_scoring,
        "op11_bpe": bpe.op11_bpe,
        "op12_alignment": alignment.op12_alignment,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL, "op1_exact_dedup": exact_dedup.OP1_SQL, "op2_decontamination": decontamination.OP2_SQL, "op9_licenses": licenses.OP9_SQL, "op7_warc": warc.OP7_SQL}
    return {k: v for k, v in sql.items() if v}
