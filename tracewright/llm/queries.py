"""The registered ``opN_*`` queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, chat, decontam, linededup, lm, media, ngramjoin, pii, repair, sharding, spelling, tokencount, toxicity
from tracewright.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontam_query(spark, sf_dir)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_query(load(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(load(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(load(spark, sf_dir, "documents")).drop("media")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.drop("ids")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_query(load(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_query(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_query(load(spark, sf_dir, "conversations"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_query(load(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_media": op6_media,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
}

SQL: dict[str, str] = {
    "op1_decontamination": decontam.DECONTAM_SQL,
    "op4_line_dedup": linededup.LINE_SQL,
    "op5_ngram_join": ngramjoin.NGRAM_SQL,
    "op10_chat_formatting": chat.CHAT_SQL,
    "op11_conversation_repair": repair.REPAIR_SQL,
    "op12_spelling_variants": spelling.SPELLING_SQL,
}
