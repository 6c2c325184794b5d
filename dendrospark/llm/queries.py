"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dendrospark.llm.contamination import OP11_SQL, op11_contamination
from dendrospark.llm.licenses import op3_licenses
from dendrospark.llm.mixing import op8_mixing
from dendrospark.llm.near_dups import op4_near_dups
from dendrospark.llm.negatives import OP12_SQL, op12_negatives
from dendrospark.llm.neighbours import op7_neighbours
from dendrospark.llm.packing import op5_packing
from dendrospark.llm.phrases import OP13_SQL, op13_phrases
from dendrospark.llm.quality import op6_quality
from dendrospark.llm.secrets import op1_secrets
from dendrospark.llm.sharding import op2_shards
from dendrospark.llm.substrings import op9_substrings
from dendrospark.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_shards": op2_shards,
    "op3_licenses": op3_licenses,
    "op4_near_dups": op4_near_dups,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_substrings": op9_substrings,
    "op10_toxicity": op10_toxicity,
    "op11_contamination": op11_contamination,
    "op12_negatives": op12_negatives,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {"op11_contamination": OP11_SQL, "op12_negatives": OP12_SQL, "op13_phrases": OP13_SQL}
