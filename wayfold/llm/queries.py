"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import jaccard, lines, negatives, pivots, quality, secrets, suffixes, tiling
from wayfold.llm.language_model import op12_lm_scores
from wayfold.llm.packing import op6_packing
from wayfold.llm.spelling import op11_spelling_variants
from wayfold.llm.token_counts import op2_token_counts
from wayfold.llm.token_orc import op5_token_orc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_leaks": tiling.op3_benchmark_leaks,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_token_orc": op5_token_orc,
    "op6_packing": op6_packing,
    "op7_near_vectors": pivots.op7_near_vectors,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality": quality.op9_quality,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op10_conversation_ledger": secrets.op10_conversation_ledger,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lm_scores": op12_lm_scores,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": jaccard.ORACLE,
    "op7_near_vectors": pivots.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op10_secret_scan": secrets.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
