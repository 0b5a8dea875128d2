"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import (
    op1_passage_attention,
    op2_warc_derivatives,
    op3_pareto_mixing,
    op4_cross_polytope,
    op5_prefix_free_parsing,
    op6_toxic_segments,
    op7_simhash,
    op8_chat_formatting,
    op9_decontamination,
    op10_substring_dedup,
    op11_angular_negatives,
    op12_line_runs,
    op13_periodic_runs,
)

_MODULES = {
    "op1_passage_attention": op1_passage_attention,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_pareto_mixing": op3_pareto_mixing,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_prefix_free_parsing": op5_prefix_free_parsing,
    "op6_toxic_segments": op6_toxic_segments,
    "op7_simhash": op7_simhash,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_angular_negatives": op11_angular_negatives,
    "op12_line_runs": op12_line_runs,
    "op13_periodic_runs": op13_periodic_runs,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: module.query for name, module in _MODULES.items()}

# fitted models, XXH64 fingerprints and byte positions are beyond SQL; those are tested against brute force
ORACLE: dict[str, str] = {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
