"""Queries of this package, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from walletlens.llm.capture_index import OP4_SQL, op4_merged_capture_index
from walletlens.llm.leak_automaton import OP11_SQL, op11_suffix_automaton
from walletlens.llm.line_dedup import OP8_SQL, op8_site_spread_lines
from walletlens.llm.minhash_dedup import OP6_SQL, op6_tensored_minhash
from walletlens.llm.mixing import op10_temperature_mixing
from walletlens.llm.packing import op1_best_two_fit
from walletlens.llm.periodic_runs import OP12_SQL, op12_sparse_diagonals
from walletlens.llm.quality_rules import op7_hashed_ngram_quality
from walletlens.llm.sharding import op3_bounded_ring
from walletlens.llm.spelling_variants import OP13_SQL, op13_bloom_neighbours
from walletlens.llm.substring_dedup import op5_gear_chunk_passages
from walletlens.llm.token_counts import op9_whole_token_shortcut
from walletlens.llm.vector_search import op2_multiprobe_p_stable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_two_fit": op1_best_two_fit,
    "op2_multiprobe_p_stable": op2_multiprobe_p_stable,
    "op3_bounded_ring": op3_bounded_ring,
    "op4_merged_capture_index": op4_merged_capture_index,
    "op5_gear_chunk_passages": op5_gear_chunk_passages,
    "op6_tensored_minhash": op6_tensored_minhash,
    "op7_hashed_ngram_quality": op7_hashed_ngram_quality,
    "op8_site_spread_lines": op8_site_spread_lines,
    "op9_whole_token_shortcut": op9_whole_token_shortcut,
    "op10_temperature_mixing": op10_temperature_mixing,
    "op11_suffix_automaton": op11_suffix_automaton,
    "op12_sparse_diagonals": op12_sparse_diagonals,
    "op13_bloom_neighbours": op13_bloom_neighbours,
}

SQL: dict[str, str] = {
    "op4_merged_capture_index": OP4_SQL,
    "op6_tensored_minhash": OP6_SQL,
    "op8_site_spread_lines": OP8_SQL,
    "op11_suffix_automaton": OP11_SQL,
    "op12_sparse_diagonals": OP12_SQL,
    "op13_bloom_neighbours": OP13_SQL,
}
