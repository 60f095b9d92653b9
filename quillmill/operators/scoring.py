"""Per-token scores and bits per byte.

A score table has ``target_id`` and ``nats`` (plus ``pos`` and keys of the caller)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import IGNORE_INDEX

# Pair tables of vocabularies up to this size are broadcast; of larger ones only the heavy pairs are.
BROADCAST_VOCAB = 1024
# A pair is heavy with at least this share of all counts, so there are at most as many as its inverse.
HEAVY_SHARE = 1 / 20_000


def join_token_bytes(tokens: DataFrame, token_bytes: DataFrame, target: str = "target_id") -> DataFrame:
    """Add ``n_bytes`` by token id. Ids below zero are never looked up: they and
    unknown ids get null. The table has one row per vocabulary entry."""
    lookup = token_bytes.filter(F.col("token_id") >= 0).select(F.col("token_id").alias(target), "n_bytes")
    return tokens.join(F.broadcast(lookup), target, "left")


def mask_ignored_targets(df: DataFrame, target: str = "target_id") -> DataFrame:
    """Ignored targets count no bytes and no loss."""
    real = F.col(target) >= 0
    return df.withColumns({
        "n_bytes": F.when(real, F.coalesce("n_bytes", F.lit(0))).otherwise(0),
        "nats": F.when(real, F.col("nats")).otherwise(0.0),
    })


def drop_special_from_metric(df: DataFrame) -> DataFrame:
    """Loss counts only where the target stands for bytes."""
    return df.withColumn("nats", F.when(F.col("n_bytes") > 0, F.col("nats")).otherwise(0.0))


def bpb_ratio(nats: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes == 0, F.lit(float("inf"))).otherwise(nats / (F.lit(math.log(2)) * n_bytes))


def bits_per_byte(
    scores: DataFrame, token_bytes: DataFrame, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Total nats and bytes and their ratio in bits, per group. ``weight`` names a
    column that says how many equal rows one row stands for."""
    times = F.col(weight) if weight else F.lit(1)
    counted = drop_special_from_metric(mask_ignored_targets(join_token_bytes(scores, token_bytes)))
    sums = counted.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("nats") * times), F.lit(0.0)).alias("nats"),
        F.coalesce(F.sum(F.col("n_bytes").cast("bigint") * times), F.lit(0)).alias("n_bytes"),
    )
    return sums.withColumn("bpb", bpb_ratio(F.col("nats"), F.col("n_bytes")))


SCORE_FIELDS = [
    T.StructField("target_ids", T.ArrayType(T.IntegerType())),
    T.StructField("nats", T.ArrayType(T.DoubleType())),
    T.StructField("pred_ids", T.ArrayType(T.IntegerType())),
]

# Padded positions that a scorer sees at once.
TOKENS_PER_CALL = 1 << 18

Scorer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _buckets(lengths: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Row numbers in groups of like length that take at most ``limit`` padded positions each, or are one row."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 1]
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * lengths[order[i]] > limit:
            yield order[start:i]
            start = i


def _flat_scores(scorer: Scorer, values: np.ndarray, lengths: np.ndarray, limit: int, pad_id: int):
    """Losses and predictions of all sequences, end to end; a sequence has one less than tokens."""
    starts = np.cumsum(lengths) - lengths
    scored = np.maximum(lengths - 1, 0)
    places = np.cumsum(scored) - scored
    nats, preds = np.empty(scored.sum()), np.empty(scored.sum(), dtype=np.int32)
    for rows in _buckets(lengths, limit):
        width = lengths[rows].max()
        steps = np.arange(width)
        real = steps < lengths[rows, None]
        padded = np.full(real.shape, pad_id, dtype=np.int32)
        padded[real] = values[(starts[rows, None] + steps)[real]]
        row_nats, row_preds = scorer(padded, lengths[rows])
        into = (places[rows, None] + steps[:-1])[real[:, 1:]]
        nats[into], preds[into] = row_nats[real[:, 1:]], row_preds[real[:, 1:]]
    return nats, preds, scored


def score_with(
    df: DataFrame, make_scorer: Callable[[], Scorer], key: str, ids: str = "ids",
    max_tokens: int = TOKENS_PER_CALL, pad_id: int = 0,
) -> DataFrame:
    """Score token arrays with any model: ``(key, target_ids, nats, pred_ids)``, one row per sequence, whose
    arrays are one shorter than ``ids`` (empty for null and for fewer than two tokens).

    ``make_scorer`` runs once per task and returns a function from sequences of like length, padded with
    ``pad_id`` to an array ``[n, width]``, and their lengths to losses and predictions ``[n, width - 1]``; what it says
    about padding is ignored. A call has at most ``max_tokens`` positions, or one longer sequence."""
    schema = T.StructType([df.schema[key], *SCORE_FIELDS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            seqs = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(seqs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = seqs.flatten().to_numpy(zero_copy_only=False)
            nats, preds, scored = _flat_scores(scorer, values, lengths, max_tokens, pad_id)
            first = np.zeros(len(values), dtype=bool)
            first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            offsets = pa.array(np.concatenate([[0], np.cumsum(scored)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (values[~first].astype(np.int32), nats, preds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], schema.names)

    return df.select(key, F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(score, schema)


def score_rows(scored: DataFrame, key: str) -> DataFrame:
    """The scores of ``score_with`` as one row per position: ``(key, pos, target_id, nats, pred_id)``."""
    steps = F.arrays_zip(F.col("target_ids").alias("target_id"), "nats", F.col("pred_ids").alias("pred_id"))
    return scored.select(key, F.posexplode(steps).alias("pos", "s")).select(key, "pos", "s.target_id", "s.nats", "s.pred_id")


def unigram_counts(targets: DataFrame, target: str = "target_id") -> DataFrame:
    return targets.groupBy(F.col(target).alias("target_id")).agg(F.count(F.lit(1)).alias("n"))


def unigram_scorer(counts: DataFrame, vocab_size: int) -> DataFrame:
    """Add-one nats for every token id below ``vocab_size``: ``(target_id, nats)``."""
    ids = counts.sparkSession.range(vocab_size).select(F.col("id").cast("int").alias("target_id"))
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))  # over one row per vocabulary entry
    return ids.join(counts, "target_id", "left").select(
        "target_id", (-F.log((n + 1) / (total + vocab_size))).alias("nats")
    )


def bigram_scorer(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``(token_id, target_id)`` rows: the pair counts ``(prev_id, target_id,
    n)`` and per previous token ``(prev_id, total, pred_id)``, where ``pred_id`` is
    its most frequent follower, the lowest id on ties."""
    counts = pairs.groupBy(F.col("token_id").alias("prev_id"), "target_id").agg(F.count(F.lit(1)).alias("n"))
    heads = counts.groupBy("prev_id").agg(
        F.sum("n").alias("total"),
        F.max_by("target_id", F.struct("n", -F.col("target_id"))).alias("pred_id"),
    )
    return counts, heads


def _with_counts(targets: DataFrame, counts: DataFrame, vocab_size: int, heavy_share: float) -> DataFrame:
    """Add ``n`` of ``(prev_id, target_id)``, null for a pair without count."""
    pair = ["prev_id", "target_id"]
    if vocab_size <= BROADCAST_VOCAB:
        return targets.join(F.broadcast(counts), pair, "left")
    # Pairs follow Zipf's law. Rows of heavy pairs are counted in place, and only the others are shuffled,
    # where no pair has more than the share of the counts.
    total = counts.agg(F.sum("n").alias("t")).scalar()
    heavy = counts.filter(F.col("n") >= total * heavy_share).withColumnRenamed("n", "_heavy")
    split = targets.join(F.broadcast(heavy), pair, "left")
    light = split.filter(F.col("_heavy").isNull()).drop("_heavy").join(counts, pair, "left")
    return split.filter(F.col("_heavy").isNotNull()).withColumnRenamed("_heavy", "n").unionByName(light)


def ngram_scores(
    targets: DataFrame, counts: DataFrame, heads: DataFrame, vocab_size: int, heavy_share: float = HEAVY_SHARE
) -> DataFrame:
    """Add ``nats`` (add-one bigram) and ``pred_id`` to rows with ``prev_id`` and
    ``target_id``. ``heads`` has at most a row per vocabulary entry and ``counts`` at most ``vocab_size``
    squared; the latter is broadcast whole for small vocabularies, otherwise its heavy pairs are. ``targets`` and
    ``counts`` are then read twice, so pass stored tables when they are costly."""
    joined = _with_counts(targets, counts, vocab_size, heavy_share).join(F.broadcast(heads), "prev_id", "left")
    likelihood = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + vocab_size)
    return joined.withColumns({
        "nats": F.when(F.col("target_id") != IGNORE_INDEX, -F.log(likelihood)),
        "pred_id": F.coalesce("pred_id", F.lit(0)),
    }).drop("n", "total")
