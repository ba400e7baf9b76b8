"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, neardup, pii, quality, secrets, sharding, substrings, tokens, toxicity, trie, turns, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_secrets": secrets.op4,
    "op5_near_duplicates": neardup.op5,
    "op6_suffix_repeats": substrings.op6,
    "op7_token_ids": tokens.op7,
    "op8_pii": pii.op8,
    "op9_quality_rules": quality.op9,
    "op10_sharding": sharding.op10,
    "op11_warc_archive": warc.op11,
    "op12_turn_repair": turns.op12,
    "op13_prefix_trie": trie.op13,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op11_warc_archive": warc.OP11_SQL,
    "op12_turn_repair": turns.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
