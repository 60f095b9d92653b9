"""Comparing how well vocabularies compress named texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import bpe_decode, bpe_encode
from ..functions.text import utf8_len
from ..functions.vocabulary import Vocabulary
from ..session import materialize
from .corpus import train_val_split


def first_group_text(corpus: DataFrame) -> DataFrame:
    """The first row group of the first shard as one text, documents joined by
    newlines. ``corpus`` carries ``row_group``; a group is bounded by its row count."""
    head = corpus.filter(F.col("row_group") == 0)
    picked = head.filter(F.col("shard") == head.select(F.min("shard")).scalar())
    lines = F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda r: r["text"])
    return picked.agg(F.array_join(lines, "\n").alias("text"))


def eval_texts_union(named: DataFrame, corpus: DataFrame) -> DataFrame:
    """Named texts plus a train and a validation sample; an empty validation sample
    is left out."""
    def sample(split: str, name: str) -> DataFrame:
        text = first_group_text(train_val_split(corpus, split))
        return text.select(F.lit(name).alias("name"), "text")

    val = sample("val", "val").filter(F.length("text") > 0)
    return named.select("name", "text").unionByName(sample("train", "train")).unionByName(val)


def _per_tokenizer(df: DataFrame, text: str, vocabs: dict[str, Vocabulary], make) -> DataFrame:
    """One row per text and vocabulary; the text is read once for all of them."""
    entries = [F.struct(F.lit(name).alias("tokenizer"), *make(F.col(text), v)) for name, v in vocabs.items()]
    return df.withColumn("_t", F.explode(F.array(*entries))).select(*df.columns, "_t.*")


def ratio(n_bytes: Column, n_tokens: Column) -> Column:
    return F.when(n_tokens > 0, n_bytes / n_tokens).otherwise(0.0)


def compression_stats(df: DataFrame, vocabs: dict[str, Vocabulary], name: str = "name", text: str = "text") -> DataFrame:
    """UTF-8 bytes, tokens and bytes per token of each named text group."""
    sizes = lambda t, v: (F.size(bpe_encode(t, v)).cast("bigint").alias("_tokens"),)
    counted = _per_tokenizer(
        df.select(name, text).filter(F.col(text).isNotNull()), text, vocabs, sizes
    ).withColumn("_bytes", utf8_len(F.col(text)).cast("bigint"))
    return counted.groupBy("tokenizer", name).agg(
        F.sum("_bytes").alias("n_bytes"), F.sum("_tokens").alias("n_tokens")
    ).withColumn("ratio", ratio(F.col("n_bytes"), F.col("n_tokens")))


def join_tokenizer_results(stats: DataFrame, base: str, ours: str, name: str = "name") -> DataFrame:
    """Baseline and own figures side by side, one row per text group. ``stats`` is stored first, as each side
    would else encode all texts with all vocabularies."""
    stats = materialize(stats, "stats")
    side = lambda which, prefix: stats.filter(F.col("tokenizer") == which).select(
        name, F.col("n_tokens").alias(f"{prefix}_tokens"), F.col("ratio").alias(f"{prefix}_ratio")
    )
    return side(base, "base").join(side(ours, "ours"), name)


def compression_compare(stats: DataFrame, base: str, ours: str, name: str = "name") -> DataFrame:
    """Relative token saving in percent and the tokenizer with the better ratio."""
    b, o = F.col("base_tokens"), F.col("ours_tokens")
    better = (
        F.when(F.col("base_ratio") > F.col("ours_ratio"), base)
        .when(F.col("ours_ratio") > F.col("base_ratio"), ours)
        .otherwise("Tie")
    )
    return join_tokenizer_results(stats, base, ours, name).withColumns({
        "relative_diff": F.when(b > 0, (b - o) / b * 100).otherwise(0.0),
        "better": better,
    })


def roundtrip_check(df: DataFrame, vocabs: dict[str, Vocabulary], name: str = "name", text: str = "text") -> DataFrame:
    """Texts per group that decoding does not give back."""
    decoded = lambda t, v: (bpe_decode(bpe_encode(t, v), v).alias("_decoded"),)
    back = _per_tokenizer(df.select(name, text).filter(F.col(text).isNotNull()), text, vocabs, decoded)
    return back.groupBy("tokenizer", name).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("_decoded") != F.col(text)).alias("n_failed")
    )
