"""Queries of this subpackage, by name, and the SQL that checks them where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import bpe, debruijn, decontam, divergence, hard_negatives, html_extract, minhash, pii, quality, sharding, suffix_dedup, tool_calls, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_site_style_tree": html_extract.op3_site_style_tree,
    "op4_interleaved_shards": sharding.op4_interleaved_shards,
    "op5_tool_call_linking": tool_calls.op5_tool_call_linking,
    "op5_every_turn": tool_calls.op5_every_turn,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_no_random_access": topk.op8_no_random_access,
    "op9_winnowing": decontam.op9_winnowing,
    "op10_surrogates": pii.op10_surrogates,
    "op11_debruijn_dedup": debruijn.op11_debruijn_dedup,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op5_tool_call_linking": tool_calls.OP5_SQL,
    "op8_no_random_access": topk.OP8_SQL,
    "op11_debruijn_dedup": debruijn.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
