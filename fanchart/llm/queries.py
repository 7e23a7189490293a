"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fanchart.llm import bit_sliced, bpe, divergence, graph_search, lines, links, mixing, near_dup, packing, resampling, suffix, token_count, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_ann": graph_search.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_counts": token_count.op5_token_counts,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_exact_topk": bit_sliced.op7_exact_topk,
    "op8_url_filters": links.op8_url_filters,
    "op9_suffix_dedup": suffix.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_resampling": resampling.op11_resampling,
    "op12_divergence": divergence.op12_divergence,
    "op13_packing": packing.op13_packing,
}
SQL: dict[str, str] = {
    "op6_line_dedup": lines.SQL, "op7_exact_topk": bit_sliced.SQL, "op10_mixing": mixing.SQL, "op11_resampling": resampling.SQL, "op12_divergence": divergence.SQL,
}
