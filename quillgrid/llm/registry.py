"""The subpackage's queries, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, bpe_trie, dartminhash, mixing, mpegts, quality_gbt, secrets_ledger, substring, toxicity, warc_merkle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_stream": mpegts.op1,
    "op2_secret_ledger": secrets_ledger.op2,
    "op3_bitsliced_topk": bitsliced.op3,
    "op4_dart_minhash": dartminhash.op4,
    "op5_bpe_trie": bpe_trie.op5,
    "op6_toxicity": toxicity.op6,
    "op7_substring_dedup": substring.op7,
    "op8_warc_merkle": warc_merkle.op8,
    "op9_quality_trees": quality_gbt.op9,
    "op10_fair_queue_mix": mixing.op10,
}
ORACLE_SQL: dict[str, str] = {
    "op2_secret_ledger": secrets_ledger.ORACLE,
    "op3_bitsliced_topk": bitsliced.ORACLE,
    "op7_substring_dedup": substring.ORACLE,
    "op8_warc_merkle": warc_merkle.ORACLE,
    "op10_fair_queue_mix": mixing.ORACLE,
}
