"""The queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ringside.llm import chunkdedup, credentials, importance, katz, langid, mixing, oracles, packing, prefixtrie, quality, suffixlevels, superminhash, syncmers, tokens
from ringside.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule of the cascade rejects a row depends on their measured order, so it's no part of the result
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


#: Target weights of the mix: one large source held down, the rest even, a small share for any other.
WEIGHTS = {"src0": 0.15, **{f"src{i}": 0.8 / 19 for i in range(1, 20)}, mixing.OTHER: 0.05}


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = mixing.schedule(docs, WEIGHTS)
    return found.select("doc_id", "mix_source", "mix_block", "mix_release", "mix_slot", "mix_deadline", "mix_key")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlevels.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_source_mix, op3_token_counts, op4_language, op5_fingerprints, op6_repeated_passages, op7_packing, op8_secrets, op9_lm_scores, op10_near_duplicates, op11_importance_draw, op12_repeated_substrings, op13_conversation_trie)
}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": oracles.QUALITY, "op10_near_duplicates": oracles.NEAR_DUPLICATES, "op11_importance_draw": oracles.IMPORTANCE, "op12_repeated_substrings": oracles.SUBSTRINGS, "op13_conversation_trie": oracles.TRIE}
