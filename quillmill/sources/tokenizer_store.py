"""Saving and loading a vocabulary as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.vocabulary import Vocabulary
from ..operators.vocabulary import merges_table, token_bytes_table, vocab_table


def tokenizer_tables_write(spark: SparkSession, vocab: Vocabulary, path: str) -> None:
    """Write ``vocab``, ``merges`` and ``token_bytes`` under ``path``."""
    vocab_table(spark, vocab).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    merges_table(spark, vocab).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    token_bytes_table(spark, vocab).coalesce(1).write.mode("overwrite").parquet(f"{path}/token_bytes")


def tokenizer_tables_read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("vocab", "merges", "token_bytes")}


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary object; its size is bounded by the vocabulary size."""
    rows = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return Vocabulary(tuple((r["left_id"], r["right_id"], r["new_id"]) for r in rows))
