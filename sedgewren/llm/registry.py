"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.bpe import op9_bpe
from sedgewren.llm.byte_cnn import op1_quality_cnn
from sedgewren.llm.fingerprints import op3_fingerprints
from sedgewren.llm.jaccard_join import op4_ngram_join
from sedgewren.llm.language_id import op5_language_id
from sedgewren.llm.packing import op8_packing
from sedgewren.llm.pii import op2_pii
from sedgewren.llm.quality_rules import op10_oracle, op10_quality_rules
from sedgewren.llm.toxicity import op7_toxicity
from sedgewren.llm.warc import op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_cnn": op1_quality_cnn,
        "op2_pii": op2_pii,
        "op3_fingerprints": op3_fingerprints,
        "op4_ngram_join": op4_ngram_join,
        "op5_language_id": op5_language_id,
        "op6_warc": op6_warc,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_bpe": op9_bpe,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": op10_oracle()}
