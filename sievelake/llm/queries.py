"""Queries over the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, line_dedup, lm_score, near_dedup, packing, quality, sstable, substring_dedup
from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.token_pieces(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return packing.unpack_ids(packed, keep_ids=False)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=13))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.digest(quality.quality(docs, keep_text=False)).drop("lang")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.format_chat(turns.unionByName(extra)))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.digest(lm_score.lm_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sstable.read_shards(spark, manifest, with_ids=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_bpe_roundtrip,
        op3_near_dedup,
        op4_best_fit_packing,
        op5_substring_dedup,
        op6_quality_rules,
        op7_learned_partitions,
        op8_chat_formatting,
        op9_lm_scores,
        op10_sorted_shards,
    )
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op3_near_dedup": near_dedup.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op9_lm_scores": lm_score.ORACLE_SQL,
}
