"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bytebpe, decontaminate, langmodel, merkle, oracles, pieces, pii, quality, resample, secrets, setjoin, substrings, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_ngram_jaccard_join": setjoin.op2_ngram_jaccard_join,
    "op3_lm_scoring": langmodel.op3_lm_scoring,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_pii": pii.op7_pii,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_byte_bpe": bytebpe.op12_byte_bpe,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": oracles.OP1,
    "op2_ngram_jaccard_join": oracles.OP2,
    "op6_benchmark_decontamination": oracles.OP6,
    "op9_substring_dedup": oracles.OP9,
    "op11_importance_resampling": oracles.OP11,
    "op13_merkle_manifest": oracles.OP13,
}
