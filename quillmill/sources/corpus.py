"""Reading sharded Parquet text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_SHARDS, SHARD_NAME_FORMAT
from ..session import spread


def corpus_scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Documents of a folder of Parquet files as ``(shard, row, text)`` plus any
    other columns asked for. Only those columns are read; other file endings
    (unfinished ``.tmp`` files) are skipped. Corpus order is ``(shard, row)``."""
    return (
        spark.read.option("pathGlobFilter", "*.parquet")
        .parquet(path)
        .select(
            F.col("_metadata.file_name").alias("shard"),
            F.col("_metadata.row_index").alias("row"),
            "text",
            *columns,
        )
    )


def corpus_from_table(spark: SparkSession, path: str, shard: str, row: str, *columns: str) -> DataFrame:
    """A corpus whose shard and row order are columns of one table."""
    table = spark.read.parquet(path).select(
        F.col(shard).alias("shard"), F.col(row).alias("row"), "text", *columns
    )
    return spread(table, "shard", "row")


def split_files(df: DataFrame, split: str) -> DataFrame:
    """``train_val_split`` for a ``corpus_scan``: the last file by name is found in
    the file listing, so the scan skips files and reads no data to decide."""
    names = sorted(path.rsplit("/", 1)[-1] for path in df.inputFiles())
    last = F.lit(names[-1] if names else None)
    if split == "val":
        return df.filter(F.col("shard") == last)
    if split == "train":
        return df.filter(F.col("shard") != last)
    raise ValueError("split must be 'train' or 'val'")


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Names and modification times under ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime")
    )


def shard_manifest(spark: SparkSession, n: int = -1) -> DataFrame:
    """Expected shard names; ``-1`` asks for all of them."""
    count = MAX_SHARDS if n == -1 else min(n, MAX_SHARDS)
    return spark.range(count).select(
        F.col("id").alias("shard_index"), F.format_string(SHARD_NAME_FORMAT, "id").alias("name")
    )


def missing_shards(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected shards that the listing lacks."""
    return manifest.join(listing.select("name").distinct(), "name", "left_anti")


def download_summary(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """How many of the expected shards are present."""
    present = listing.select("name", F.lit(True).alias("present")).distinct()
    return manifest.join(present, "name", "left").agg(
        F.count_if(F.col("present")).alias("n_done"), F.count(F.lit(1)).alias("n_total")
    )
