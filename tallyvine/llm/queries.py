"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, exact_dedup, mixing, near_dedup, ngram_join, pii, quality, repeats, secrets, sharding, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_quality": quality.op2_quality,
    "op3_repeats": repeats.op3_repeats,
    "op4_secrets": secrets.op4_secrets,
    "op5_pii": pii.op5_pii,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_spelling": spelling.op12_spelling,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES: dict[str, str] = {
    "op3_repeats": repeats.ORACLE_SQL,
    "op4_secrets": secrets.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_ngram_join": ngram_join.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
}
