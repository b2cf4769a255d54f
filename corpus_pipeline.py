"""From raw documents to packed training sequences.

Stages, each over all rows its predecessor kept: quality rules, line dedup, MinHash near-dedup,
substring dedup, best-fit packing.  All but the last return the columns of ``documents`` (with
``n_chars`` of the text as it then is); the last returns token pieces with their sequences.

Defined cases are those of the operators: null text fails the quality rules; a null doc_id is no
duplicate of another; extra columns of ``docs`` are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import stage
from sievelake.llm.line_dedup import dedup_lines
from sievelake.llm.near_dedup import near_duplicates
from sievelake.llm.packing import pack, token_pieces, unpack_ids
from sievelake.llm.quality import quality
from sievelake.llm.substring_dedup import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _documents(quality(docs.select(*COLUMNS)).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go but for their first place; documents stay."""
    return _documents(dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates stays."""
    docs = docs.select(*COLUMNS)
    drop = stage(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-duplicates")
    return _documents(docs.join(drop, docs.doc_id == drop._gone, "left_anti"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in an earlier document go; documents stay."""
    return _documents(dedup_substrings(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, sequence_id, offset, ids_crc32, ids)."""
    return unpack_ids(pack(token_pieces(docs.select("doc_id", "text"))))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Corpus-trained references, MinHash components and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
