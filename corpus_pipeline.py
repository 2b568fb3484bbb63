"""The corpus pipeline: language, near copies, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns the
columns of ``documents``; the last one returns packed pieces. ``run`` writes each stage's rows to the
shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import language, near_copies, packing, suffix_dedup
from fathomline.llm.common import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3  # a document goes if no language reaches it


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, as ``lang``; those without a letter or under ``LEAST_SCORE`` go."""
    found = language.identify(docs, language.fit(docs), keep=["text", "source", "n_chars"])
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id (null ids last; of two texts of that id, one)."""
    return near_copies.keep_one(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; ``n_chars`` counts what is left, and emptied documents go."""
    left = suffix_dedup.remove_repeats(docs, keep=["lang", "source"])
    left = left.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", identify),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: SQL can't express the network, the tokenizer or the bins; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
