"""Pre-token statistics, BPE training and vocabulary tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import byte_symbols
from ..functions.sequences import inputs_of, targets_of
from ..functions.text import pretokenize
from ..functions.vocabulary import Vocabulary

VOCAB_SCHEMA = T.StructType([
    T.StructField("token_id", T.IntegerType(), False),
    T.StructField("bytes", T.BinaryType(), False),
    T.StructField("is_special", T.BooleanType(), False),
])
MERGES_SCHEMA = "rank int, left_id int, right_id int, new_id int"
TOKEN_BYTES_SCHEMA = "token_id int, n_bytes int"
CHARS_PER_PASS = 1 << 18  # of texts whose ids a tokenizer gives as Python lists


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each pre-token occurs; counts are combined before the shuffle."""
    return (
        df.select(F.explode(pretokenize(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def word_symbols(words: DataFrame) -> DataFrame:
    """Pre-tokens as arrays of base symbols: ``(symbols, n)``."""
    return words.select(byte_symbols(F.col("token")).alias("symbols"), "n")


def pair_totals(words: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbols of ``(symbols, n)``."""
    pairs = F.arrays_zip(
        inputs_of(F.col("symbols")).alias("left_id"), targets_of(F.col("symbols")).alias("right_id")
    )
    return (
        words.select(F.explode(pairs).alias("p"), "n")
        .groupBy("p.left_id", "p.right_id")
        .agg(F.sum("n").alias("n"))
    )


def adjacent_pair_counts(words: DataFrame) -> DataFrame:
    """Weighted counts of adjacent base symbols of ``(token, n)`` as ``(left_id,
    right_id, n)``."""
    return pair_totals(word_symbols(words))


def vocab_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    rows = [(i, bytearray(v), vocab.is_special(i)) for i, v in enumerate(vocab.token_values)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def merges_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    return spark.createDataFrame([(r, *m) for r, m in enumerate(vocab.merges)], MERGES_SCHEMA)


def token_bytes_table(spark: SparkSession, vocab: Vocabulary, mode: str = "raw") -> DataFrame:
    """Byte length of every token, 0 for special tokens."""
    return spark.createDataFrame([(i, vocab.n_bytes(i, mode)) for i in range(vocab.size)], TOKEN_BYTES_SCHEMA)


def vocab_lookup(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Ids of token strings; unknown ones get null. A vocabulary is bounded by its
    requested size, so it is broadcast."""
    by_text = vocab.select(F.col("bytes").alias("_bytes"), "token_id")
    return tokens.join(
        F.broadcast(by_text), F.encode(F.col(token), "UTF-8") == F.col("_bytes"), "left"
    ).drop("_bytes")


def token_lookup(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token bytes of ids; unknown ids get null."""
    return ids.join(F.broadcast(vocab.select("token_id", "bytes")), "token_id", "left")


def vocab_minus_special(vocab: DataFrame) -> DataFrame:
    special = vocab.filter("is_special").select("bytes")
    return vocab.join(F.broadcast(special), "bytes", "left_anti")


def by_size(texts: pd.Series) -> Iterator[pd.Series]:
    """A batch of texts as runs of about ``CHARS_PER_PASS``."""
    ends = np.cumsum([0 if t is None else len(t) for t in texts])
    for _, run in texts.groupby(ends // CHARS_PER_PASS):
        yield run


def tokenize_with(df: DataFrame, make_tokenizer: Callable[[], Callable[[str], list[int]]], text: str = "text",
                  out: str = "ids") -> DataFrame:
    """Add ids from any tokenizer. ``make_tokenizer`` runs once per task on the
    workers. A batch is tokenized in runs of rows of about ``CHARS_PER_PASS``, of each run every distinct text once."""
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make_tokenizer()
        for batch in batches:
            for texts in by_size(batch):
                known = {t: list(run(t)) for t in texts.dropna().unique()}
                yield texts.map(known).astype(object).where(texts.notna(), None)

    return df.withColumn(out, F.pandas_udf(tokenize, "array<int>").asNondeterministic()(F.col(text)))
