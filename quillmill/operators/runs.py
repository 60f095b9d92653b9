"""Step logs and checkpoint listings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMA_BETA, EVAL_EVERY, PEAK_FLOPS, TOKENS_PER_STEP, WARMUP_STEPS
from .prefix import int_div, running_total

# --- fixed values: artifact names ----------------------------------------------
MODEL_FILE = r"^model_(\d+)\.pt$"
MODEL_TAG = r"^d(\d+)"


def every_n_steps(log: DataFrame, n: int = EVAL_EVERY, step: str = "step") -> DataFrame:
    """Steps at which an evaluation runs, step 0 included."""
    return log.filter(F.col(step) % n == 0)


def ema_debiased(
    log: DataFrame, value: str, out: str, by: Sequence[str] = ("run_id",), step: str = "step", beta: float = EMA_BETA
) -> DataFrame:
    """Add the debiased moving average of ``value``; steps count from 0 without gaps.

    The average is a sum weighted by powers of ``beta``, so a block of steps needs
    only its own rows and the averages at the ends of a few earlier blocks; those
    further back weigh less than a rounding error. No run is sorted as a whole."""
    block = max(1, int(-math.log(1e-100) / -math.log(beta)))  # beta**-block stays below 1e100
    reach = max(1, math.ceil(math.log(1e-20) / (block * math.log(beta))))
    keys = list(by)
    at = F.col(step) % block
    rows = log.withColumns({"_b": int_div(F.col(step), block), "_at": at})
    weighted = F.col(value) * (1 - beta) * F.pow(F.lit(beta), -F.col("_at"))
    frame = Window.partitionBy(*keys, "_b").orderBy("_at")
    ends = rows.groupBy(*keys, "_b").agg(
        (F.sum(weighted) * F.pow(F.lit(beta), F.lit(block - 1))).alias("_end")
    )
    # What each block passes on to the next ones, already decayed to their start.
    carried = (
        ends.select(*keys, "_b", "_end", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d"))
        .select(*keys, (F.col("_b") + F.col("_d")).alias("_b"),
                (F.col("_end") * F.pow(F.lit(beta), (F.col("_d") - 1) * block)).alias("_c"))
        .groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_carry"))
    )
    smooth = F.pow(F.lit(beta), "_at") * F.sum(weighted).over(frame)
    carry = F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(beta), F.col("_at") + 1)
    debias = 1 - F.pow(F.lit(beta), F.col(step) + 1)
    return (
        rows.withColumn("_s", smooth)
        .join(carried, [*keys, "_b"], "left")
        .withColumn(out, (F.col("_s") + carry) / debias)
        .select(*log.columns, out)
    )


def running_min_val(
    log: DataFrame, value: str, out: str, by: Sequence[str] = ("run_id",), step: str = "step"
) -> DataFrame:
    """Add the best value so far, this step included."""
    return running_total(log, F.col(value), out, by=by, row=step, op="min", inclusive=True)


def step_metrics(
    log: DataFrame, num_iterations: int, flops_per_token: float, world: int,
    batch_tokens: int = TOKENS_PER_STEP, step: str = "step", dt: str = "dt_s",
) -> DataFrame:
    """Progress, throughput and hardware use of every step."""
    return log.withColumns({
        "pct_done": F.col(step) * 100 / num_iterations,
        "tok_per_sec": F.floor(F.lit(batch_tokens) / F.col(dt)).cast("bigint"),
        "flops_so_far": F.col(step) * F.lit(float(flops_per_token) * batch_tokens),
        "mfu": F.lit(100.0 * flops_per_token * batch_tokens) / F.col(dt) / F.lit(PEAK_FLOPS * world),
    })


def training_time(log: DataFrame, by: Sequence[str] = ("run_id",), step: str = "step", dt: str = "dt_s") -> DataFrame:
    """Seconds spent in steps after the warm-up."""
    counted = F.when(F.col(step) > WARMUP_STEPS, F.col(dt))
    return log.groupBy(*by).agg(F.coalesce(F.sum(counted), F.lit(0.0)).alias("total_time_s"))


def checkpoint_names(listing: DataFrame) -> DataFrame:
    """Model checkpoints of a listing ``(path, mtime)`` as ``(tag, step, mtime)``.
    Other files give a row without a step, which still counts as an update of its
    tag's folder."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return listing.select(
        F.element_at(parts, -2).alias("tag"),
        F.when(name.rlike(MODEL_FILE), F.regexp_extract(name, MODEL_FILE, 1).cast("bigint")).alias("step"),
        "mtime",
    )


def latest_step(checkpoints: DataFrame) -> DataFrame:
    """The highest step of each tag, compared as a number."""
    return checkpoints.filter(F.col("step").isNotNull()).groupBy("tag").agg(F.max("step").alias("step"))


def largest_model(checkpoints: DataFrame) -> DataFrame:
    """The tag with the greatest depth, else the one updated last. Ties go to the
    first tag by name."""
    tags = checkpoints.groupBy("tag").agg(F.max("mtime").alias("mtime"))
    depth = F.when(F.col("tag").rlike(MODEL_TAG), F.regexp_extract("tag", MODEL_TAG, 1).cast("bigint"))
    ranked = tags.select(
        "tag",
        F.struct(
            F.when(depth.isNull(), 1).otherwise(0),
            -F.coalesce(depth, F.lit(0)),
            F.when(depth.isNull(), -F.unix_micros("mtime")).otherwise(0),
            "tag",
        ).alias("place"),
    )
    return ranked.agg(F.min_by("tag", "place").alias("tag"))


def resolve_checkpoint(checkpoints: DataFrame, tag: str | None = None, step: int | None = None) -> DataFrame:
    """The ``(tag, step)`` to load. A given tag or step wins; nothing found is an error."""
    spark = checkpoints.sparkSession
    wanted = spark.createDataFrame([(tag,)], "tag string") if tag is not None else largest_model(checkpoints)
    found = wanted.join(latest_step(checkpoints), "tag", "left")
    chosen = F.coalesce(F.lit(step).cast("bigint"), "step")
    missing = F.raise_error(F.lit("no checkpoints found")).cast("bigint")
    return found.select("tag", F.coalesce(chosen, missing).alias("step"))
