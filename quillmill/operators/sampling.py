"""Seeded shuffles and few-shot sampling without pairs of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEWSHOT_SEED, SHUFFLE_SEED
from ..functions.hashing import hash32, key_md5
from .prefix import shuffled_position


def seeded_shuffle(items: DataFrame, task: str = "task", item: str = "item_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Add ``idx``, the place of each item in a fixed shuffle of its task."""
    return shuffled_position(items, key_md5(seed, F.col(item)), "idx", by=[task], tie=item)


def limit_per_task(shuffled: DataFrame, k: int) -> DataFrame:
    """The first k items of every task after the shuffle; ``k <= 0`` keeps all."""
    return shuffled if k <= 0 else shuffled.filter(F.col("idx") < k)


def fewshot_candidates(shuffled: DataFrame, task: str = "task") -> DataFrame:
    """Add ``n_candidates``: how many other items of its task an item may draw from."""
    sizes = shuffled.groupBy(task).agg((F.count(F.lit(1)) - 1).alias("n_candidates"))
    return shuffled.join(sizes, task)


def _draws(idx: Column, n: Column, k: Column, seed: int) -> Column:
    """k distinct numbers below ``n``, every set equally likely: step i draws from
    the first ``n-k+i+1`` numbers and takes the newest one if the draw repeats."""
    def step(taken: Column, i: Column) -> Column:
        top = n - k + i
        drawn = F.pmod(hash32(idx + seed, i), top + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, drawn), top).otherwise(drawn))

    none = F.array().cast("array<bigint>")
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(0), k - 1), none, step)).otherwise(none)


def fewshot_sample(shuffled: DataFrame, k: int | Column, seed: int = FEWSHOT_SEED, task: str = "task") -> DataFrame:
    """For each item k other items of its task, as ``(task, idx, draw, other_idx)``. ``k``
    may be a column of the items, so that each task has its own number; zero draws none.
    Positions are drawn, so no pairs are formed. Too few others is an error."""
    wanted = (F.lit(k) if isinstance(k, int) else k).cast("int")
    pool = fewshot_candidates(shuffled.select(task, "idx", wanted.alias("_k")), task)
    drawn_ids = _draws(F.col("idx"), F.col("n_candidates"), F.col("_k"), seed)
    enough = F.when(F.col("n_candidates") >= F.col("_k"), drawn_ids).otherwise(
        F.raise_error(F.concat(F.lit("too few items to sample from in task "), F.col(task).cast("string")))
    )
    drawn = pool.select(task, "idx", F.posexplode(enough).alias("draw", "pick"))
    # positions at or after the item itself move up by one
    other = F.col("pick") + F.when(F.col("pick") >= F.col("idx"), 1).otherwise(0)
    return drawn.select(task, "idx", "draw", other.alias("other_idx"))


def fewshot_gather(
    shuffled: DataFrame, drawn: DataFrame, fields: list[str], out: str = "shots", task: str = "task"
) -> DataFrame:
    """Items with their drawn examples as an array of structs in draw order (empty
    when nothing was drawn). An array holds the k examples of one item."""
    others = shuffled.select(task, F.col("idx").alias("other_idx"), F.struct(*fields).alias("shot"))
    shots = (
        drawn.join(others, [task, "other_idx"])
        .groupBy(task, "idx")
        .agg(F.sort_array(F.collect_list(F.struct("draw", "shot"))).alias("s"))
        .select(task, "idx", F.transform("s", lambda x: x["shot"]).alias(out))
    )
    empty = F.array().cast(shots.schema[out].dataType)
    return shuffled.join(shots, [task, "idx"], "left").withColumn(out, F.coalesce(out, empty))
