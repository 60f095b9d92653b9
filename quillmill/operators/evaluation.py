"""Few-shot task evaluation over score tables.

An item is one row: ``task, idx, task_type, query, choices, gold, context_options,
context, continuation`` (fields of other task types are null). Prompts, token
sequences and spans of an item stay in its row until scores are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOS, TOTAL_LABEL
from ..functions.codec import bpe_encode_each
from ..functions.prompts import render_lm, render_mc, render_schema
from ..functions.sequences import (
    common_prefix_len,
    common_suffix_len,
    crop_left,
    cropped_index,
    shared_prefix,
)
from ..functions.vocabulary import BYTE_LEVEL, Vocabulary

MC, SCHEMA, LM = "multiple_choice", "schema", "language_modeling"
SHOT_FIELDS = ["query", "choices", "gold", "context_options", "context", "continuation"]


def render_prompts(items: DataFrame, delimiter: str = "delimiter", shots: str = "shots") -> DataFrame:
    """Add ``prompts`` by task type; an unknown type is an error."""
    delim, examples = F.col(delimiter), F.col(shots)
    kind = F.col("task_type")
    prompts = (
        F.when(kind == MC, render_mc(F.col("query"), F.col("choices"), delim, examples))
        .when(kind == SCHEMA, render_schema(F.col("context_options"), F.col("continuation"), delim, examples))
        .when(kind == LM, render_lm(F.col("context"), F.col("continuation"), delim, examples))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported task type: "), kind)).cast("array<string>"))
    )
    return items.withColumn("prompts", prompts)


def encode_prompts(items: DataFrame, vocab: Vocabulary = BYTE_LEVEL) -> DataFrame:
    """Add ``seqs``: the prompts' token ids, each after a BOS."""
    return items.withColumn("seqs", bpe_encode_each(F.col("prompts"), vocab, prepend=BOS))


def lm_prefix_ok(seqs: Column) -> Column:
    """Whether the prompt without continuation is a strict prefix of the one with it."""
    return (F.size(seqs[0]) < F.size(seqs[1])) & (shared_prefix(seqs[0], seqs[1]) == F.size(seqs[0]))


def continuation_spans(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``spans``, an array of ``(option, seq, start_at, end_at)`` structs; items
    whose continuation cannot be told apart are returned separately."""
    seqs, kind = F.col("seqs"), F.col("task_type")
    # The span start is the same in every option for mc, counted from the end for schema.
    marked = items.withColumn(
        "_shared",
        F.when(kind == MC, common_prefix_len(seqs))
        .when(kind == SCHEMA, common_suffix_len(seqs))
        .otherwise(F.size(seqs[0])),
    ).withColumn("_ok", (kind != LM) | lm_prefix_ok(seqs))
    span = lambda s, option, start: F.struct(
        option.cast("int").alias("option"), s.alias("seq"),
        start.cast("int").alias("start_at"), F.size(s).alias("end_at"),
    )
    spans = F.when(kind == LM, F.array(span(seqs[1], F.lit(0), F.col("_shared")))).otherwise(
        F.transform(
            seqs,
            lambda s, i: span(s, i, F.when(kind == SCHEMA, F.size(s) - F.col("_shared")).otherwise(F.col("_shared"))),
        )
    )
    good = marked.filter("_ok").withColumn("spans", spans).drop("_shared", "_ok")
    return good, marked.filter(~F.col("_ok")).drop("_shared", "_ok")


def crop_spans(items: DataFrame, max_len: int) -> DataFrame:
    """Keep the last ``max_len`` tokens of every option; a span that starts before
    the crop is an error."""
    def crop(s: Column) -> Column:
        start = cropped_index(s["start_at"], s["seq"], max_len)
        checked = F.when(start >= 0, start).otherwise(F.raise_error(F.lit("crop cut into the span")).cast("int"))
        return F.struct(
            s["option"].alias("option"), crop_left(s["seq"], max_len).alias("seq"), checked.alias("start_at"),
            cropped_index(s["end_at"], s["seq"], max_len).alias("end_at"),
        )

    return items.withColumn("spans", F.transform("spans", crop))


def span_targets(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per scored token: ``(keys, option, pos, prev_id, target_id)``. The
    prediction made at ``pos`` is for the token after it. Positions outside the
    span are never exploded, and an empty span gives one row without target."""
    options = items.select(*keys, F.explode("spans").alias("s"))
    steps = F.when(
        F.col("s.end_at") > F.col("s.start_at"), F.sequence(F.col("s.start_at") - 1, F.col("s.end_at") - 2)
    )
    return options.select(*keys, F.col("s.option").alias("option"), F.col("s.seq").alias("seq"),
                          F.explode_outer(steps).alias("pos")).select(
        *keys, "option", "pos",
        F.get("seq", F.col("pos")).alias("prev_id"), F.get("seq", F.col("pos") + 1).alias("target_id"),
    )


def join_prediction_target(
    rows: DataFrame, preds: str = "pred_ids", ids: str = "ids", start: str = "start_at", end: str = "end_at"
) -> DataFrame:
    """Add ``steps``, an array of ``(pos, pred_id, target_id, hit)``: the predictions made at ``[start - 1, end - 1)``
    against the tokens after them. ``preds`` holds one prediction for each token of ``ids``, or for all but the last.
    Predictions and tokens of a sequence stay in its row, so nothing is exploded or shuffled. An empty span or a null
    gives an empty array."""
    first = F.greatest(F.col(start), F.lit(1))  # 1-based place of the first prediction
    stop = F.least(F.col(end), F.size(ids), F.size(preds) + 1)
    count = F.greatest(stop - first, F.lit(0))
    none = F.array().cast("array<struct<pos:int,pred_id:int,target_id:int,hit:boolean>>")
    target = lambda i: F.get(F.col(ids), (i + F.col("_first")).cast("int"))
    steps = F.transform(F.slice(preds, F.col("_first"), F.col("_count")), lambda p, i: F.struct(
        (i + F.col("_first") - 1).cast("int").alias("pos"), p.cast("int").alias("pred_id"),
        target(i).cast("int").alias("target_id"), (p == target(i)).alias("hit"),
    ))
    # Of a sequence without tokens nothing is compared; one pass over the span makes its steps.
    steps = F.when(F.col(ids).isNotNull(), steps)
    placed = rows.withColumns({"_first": first, "_count": count})
    return placed.withColumn("steps", F.coalesce(steps, none)).drop("_first", "_count")


def _sum_of(values: Column) -> Column:
    """Sum of an array with the rounding error of every step carried along."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def step(a: Column, x: Column) -> Column:
        s = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - s) + x).otherwise((x - s) + a["s"])
        return F.struct(s.alias("s"), (a["e"] + lost).alias("e"))

    return F.aggregate(values, zero, step, lambda a: a["s"] + a["e"])


def mean_loss(nats: str = "nats") -> Column:
    """Mean of a loss column that does not depend on the order of its rows: losses are added in the
    order of their size, with the rounding errors, so options with the same losses tie exactly and the
    tie rule decides. Nothing is rounded before, whatever the size of the losses. Losses that are no finite number
    make the mean one too; no loss gives null. A group is one option, at most a sequence long."""
    x, n = F.col(nats).cast("double"), F.count(nats)
    ordered = F.array_sort(F.collect_list(x))
    finite = F.count_if(F.abs(x) < float("inf")) == n
    small = F.max(F.abs(x)) < 1e290  # so that no sum overflows
    return F.when(n == 0, F.lit(None)).when(
        finite, F.when(small, _sum_of(ordered) / n).otherwise(_sum_of(F.transform(ordered, lambda v: v / n)))
    ).otherwise(F.avg(x))


def option_mean_loss(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean loss over the scored positions of each option; null for an empty span."""
    return scores.groupBy(*keys, "option").agg(mean_loss().alias("mean_loss"))


def pick_option(losses: DataFrame, keys: list[str]) -> DataFrame:
    """The option with the least mean loss, the first on ties, null losses last."""
    order = F.struct(F.col("mean_loss").isNull(), "mean_loss", "option")
    return losses.groupBy(*keys).agg(F.min_by("option", order).alias("picked"))


def exact_match(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every predicted token of the span equals its target."""
    return scores.groupBy(*keys).agg(F.bool_and(F.col("pred_id") == F.col("target_id")).alias("correct"))


def decide_items(scores: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Correctness of every item as ``(keys, correct)``: exact match for language
    modelling, least mean loss against gold for the other task types. One
    aggregation serves both. An item without scores, because its continuation could
    not be told apart, is an error: leaving it out would change the accuracy."""
    per_option = scores.groupBy(*keys, "option").agg(
        mean_loss().alias("mean_loss"),
        F.bool_and(F.col("pred_id") == F.col("target_id")).alias("match"),
    )
    order = F.struct(F.col("mean_loss").isNull(), "mean_loss", "option")
    per_item = per_option.groupBy(*keys).agg(
        F.min_by("option", order).alias("picked"), F.bool_and("match").alias("match")
    )
    decided = F.when(F.col("task_type") == LM, F.col("match")).otherwise(F.col("picked") == F.col("gold"))
    absent = F.raise_error(F.concat_ws(" ", F.lit("no scores for item"), *keys)).cast("boolean")
    return items.select(*keys, "task_type", "gold").join(per_item.withColumn("_scored", F.lit(True)), keys, "left").select(
        *keys, F.when(F.col("_scored").isNull(), absent).otherwise(decided).alias("correct")
    )


def task_accuracy(decisions: DataFrame, task: str = "task") -> DataFrame:
    return decisions.groupBy(task).agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_items")
    )


def centered(accuracy: Column, baseline_percent: Column) -> Column:
    """Accuracy rescaled so that chance is 0 and perfect is 1."""
    chance = baseline_percent * 0.01
    return (accuracy - chance) / (F.lit(1.0) - chance)


def join_baseline(results: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    """Results with their ``baseline``, one row per task on either side. A task without
    a baseline, or with two, is an error."""
    once = baselines.groupBy(task).agg(F.max("baseline").alias("baseline"), F.count(F.lit(1)).alias("_n"))
    label = F.col(task).cast("string")
    checked = (
        F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no baseline for task "), label)).cast("double"))
        .when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one baseline for task "), label)).cast("double"))
        .otherwise(F.col("baseline"))
    )
    return results.join(once, task, "left").withColumn("baseline", checked).drop("_n")


def missing_baselines(results: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    """Task labels that have no baseline."""
    return results.join(baselines, task, "left_anti").select(task)


def duplicate_labels(tasks: DataFrame, task: str = "task") -> DataFrame:
    return tasks.groupBy(task).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def centered_accuracy(results: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    joined = join_baseline(results, baselines, task)
    return joined.withColumn("centered", centered(F.col("accuracy"), F.col("baseline")))


def core_metric(centred: DataFrame) -> DataFrame:
    """Unweighted mean over tasks."""
    return centred.agg(F.avg("centered").alias("core"))


def report_with_total(centred: DataFrame, task: str = "task") -> DataFrame:
    """Report lines: every task, then the total with a blank accuracy."""
    rows = centred.select(task, "accuracy", "centered")
    total = core_metric(rows).select(
        F.lit(TOTAL_LABEL).alias(task), F.lit(None).cast("double").alias("accuracy"), F.col("core").alias("centered")
    )
    return rows.unionByName(total)
