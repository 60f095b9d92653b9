"""Stages of a corpus pipeline: classify, judge, drop near copies, cut repeated passages, pack.

Every stage takes (session, documents, folder of the tables) and returns a table. All but the
last keep all columns of their input, whatever their names, and decide on all of its rows; null and
empty texts, ties, repeated rows and empty tables are treated as the operators' modules say.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import best_fit, decision_lists, line_crf, minhash_dedup, suffix_dedup

CAPACITY = 2048
VOCABULARY = tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the line classifier scores below one half."""
    learned = _labels(spark, sf_dir).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    field = line_crf.fit(_documents(spark, sf_dir), learned)
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return line_crf.score(rows, field).where("score >= 0.5").select("_row.*")


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or the learned list is against."""
    rules = decision_lists.fit(_documents(spark, sf_dir), _labels(spark, sf_dir))
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return decision_lists.judge(rows, rules).where("kept").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of the smallest id of each group. A row that is in no group goes only if one of
    the same id and text stays; documents without an id stay."""
    found = minhash_dedup.grouped(docs).where("kept and doc_id is not null")
    # What is in no group is its own text.
    own = F.when(F.col("group").isNull(), F.col("text_hash")).alias("own")
    kept = found.select(F.col("doc_id").alias("id"), "text_hash", "group", own).distinct()
    rows = docs.where("doc_id is not null").select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash")
    )
    first = F.row_number().over(Window.partitionBy("id", "group", "own").orderBy("text_hash", "row.text"))
    one = rows.join(kept, ["id", "text_hash"]).withColumn("nth", first).where("nth = 1")
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages that an earlier document has out of the texts."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as training sequences; the places of their token pieces in them."""
    return best_fit.places(best_fit.write_sequences(docs, VOCABULARY, CAPACITY))


STAGES = [
    ("quality_classifier", classify), ("quality_rules", judge), ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
