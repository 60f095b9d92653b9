"""Splitting, striding, cropping and budgeting an ordered corpus.

A corpus has the columns ``shard``, ``row`` and ``text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_DOC_CAP, DEFAULT_MAX_CHARS
from ..functions.text import crop
from .prefix import dense_index, int_div, running_total


def train_val_split(df: DataFrame, split: str, shard: str = "shard") -> DataFrame:
    """The last shard by name is ``val``, all others are ``train``; a corpus of one
    shard has an empty train split. Its name is a scalar subquery over the shard
    column alone, and the comparison with it reaches the scan."""
    last = df.select(F.max(shard)).scalar()
    if split == "val":
        return df.filter(F.col(shard) == last)
    if split == "train":
        return df.filter(F.col(shard) != last)
    raise ValueError("split must be 'train' or 'val'")


def with_row_group(df: DataFrame, rows_per_group: int, dense: bool = False) -> DataFrame:
    """Add ``row_group``. Unless ``row`` is known to be dense within the shard (as
    file row numbers are) positions are counted first."""
    indexed = df.withColumn("_i", F.col("row")) if dense else dense_index(df, "_i", major=None, by=["shard"])
    return indexed.withColumn("row_group", int_div(F.col("_i"), rows_per_group)).drop("_i")


def with_rank(df: DataFrame, world: int) -> DataFrame:
    """Row groups of every shard are dealt out to the ranks in turn."""
    return df.withColumn("rank", F.pmod("row_group", F.lit(world)).cast("int"))


def shard_stride(df: DataFrame, rank: int, world: int) -> DataFrame:
    """The row groups one rank reads."""
    return with_rank(df, world).filter(F.col("rank") == rank)


def after_row_group(df: DataFrame, shard: str, row_group: int, world: int) -> DataFrame:
    """What the ranks still read after a saved position: all later shards, and in
    the saved shard the stride after the one that holds the saved row group."""
    next_stride = (row_group // world + 1) * world
    return df.filter(
        (F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("row_group") >= next_stride))
    )


def doc_crop(df: DataFrame, cap: int = DEFAULT_DOC_CAP) -> DataFrame:
    """Keep the first ``cap`` characters of every text."""
    return df.withColumn("text", crop(F.col("text"), cap))


def running_chars(df: DataFrame, out: str = "chars_before", length: Column | None = None) -> DataFrame:
    """Characters of all earlier documents in corpus order."""
    n = F.length("text") if length is None else length
    return running_total(df, n.cast("bigint"), out, major="shard")


def char_budget(df: DataFrame, max_chars: int = DEFAULT_MAX_CHARS, length: Column | None = None) -> DataFrame:
    """Documents up to and including the one that crosses the limit.

    What is kept is a prefix of the corpus, so the result is a filter and no text is
    shuffled. Shards are added up in name order, in groups of growing size, until the
    budget is crossed; later shards are not read. Then only the last shard is counted row
    by row. ``length`` gives the lengths where a column holds them, and no text is read."""
    n = F.length("text") if length is None else length
    sizes = df.select("shard", "row", n.cast("bigint").alias("n"))
    names = [r["shard"] for r in df.select("shard").distinct().orderBy("shard").collect()]  # one per file
    last, before, total, at, size = None, 0, 0, 0, 1
    while at < len(names) and total <= max_chars:
        group = names[at : at + size]
        found = {r["shard"]: r["n"] for r in sizes.filter(F.col("shard").isin(group)).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        for name in group:
            if total <= max_chars:
                last, before, total = name, total, total + (found[name] or 0)
        at, size = at + size, size * 2
    if last is None:
        return df.limit(0)
    rows = running_total(sizes.filter(F.col("shard") == last), F.col("n"), "_n", by=["shard"])
    end = rows.filter(F.col("_n") + before <= max_chars).agg(F.max("row")).first()[0]
    return df.filter((F.col("shard") < last) | ((F.col("shard") == last) & (F.col("row") <= end)))


def ordered_corpus(df: DataFrame) -> DataFrame:
    """Add ``position``, the place of each document in corpus order."""
    return dense_index(df, "position", major="shard")
