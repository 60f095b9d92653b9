"""Queries over step logs and checkpoint listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..session import scratch_path
from ..sources.runs import RUN_METADATA, run_metadata_read, run_metadata_write
from . import fixtures
from .registry import query, rounded

LOG = """
log AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
         value AS loss, (value + 1) / 1000 AS dt_s
  FROM events
)"""


@query(f"WITH {LOG}\nSELECT run_id, step, round(loss, 6) AS loss FROM log WHERE step % 10 = 0", name="every_n_steps")
def steps_query(spark, sf_dir):
    return runs.every_n_steps(fixtures.step_log(spark, sf_dir), 10).select("run_id", "step", rounded(F.col("loss")).alias("loss"))


@query(f"""
WITH {LOG}
SELECT run_id, step, round(sum(0.1 * loss * pow(0.9, -step)) OVER (PARTITION BY run_id ORDER BY step) * pow(0.9, step)
       / (1 - pow(0.9, step + 1)), 6) AS smooth_loss
FROM log
""", name="ema_debiased")
def ema_query(spark, sf_dir):
    return runs.ema_debiased(fixtures.step_log(spark, sf_dir), "loss", "smooth_loss").select(
        "run_id", "step", rounded(F.col("smooth_loss")).alias("smooth_loss")
    )


@query(f"WITH {LOG}\nSELECT run_id, step, min(loss) OVER (PARTITION BY run_id ORDER BY step) AS best FROM log", name="running_min_val")
def best_query(spark, sf_dir):
    return runs.running_min_val(fixtures.step_log(spark, sf_dir), "loss", "best").select("run_id", "step", "best")


@query(f"""
WITH {LOG}
SELECT run_id, step, round(step * 100 / 500.0, 6) AS pct_done, floor(524288 / dt_s)::BIGINT AS tok_per_sec,
       round(step * 524288 * 6e9 / 1e12, 3) AS tflops_so_far, round(100 * 6e9 * 524288 / dt_s / (989e12 * 8), 6) AS mfu
FROM log
""", name="step_metrics")
def metrics_query(spark, sf_dir):
    done = runs.step_metrics(fixtures.step_log(spark, sf_dir), 500, 6e9, world=8)
    return done.select(
        "run_id", "step", rounded(F.col("pct_done")).alias("pct_done"), "tok_per_sec",
        F.round(F.col("flops_so_far") / 1e12, 3).alias("tflops_so_far"), rounded(F.col("mfu")).alias("mfu"),
    )


@query(f"""
WITH {LOG}
SELECT run_id, round(coalesce(sum(dt_s) FILTER (WHERE step > 10), 0), 6) AS total_time_s FROM log GROUP BY run_id
""", name="training_time")
def time_query(spark, sf_dir):
    return runs.training_time(fixtures.step_log(spark, sf_dir)).select("run_id", rounded(F.col("total_time_s")).alias("total_time_s"))


@query("SELECT 'd' || (user_id % 40) AS tag, max(event_id) AS step FROM events GROUP BY ALL", name="latest_step")
def latest_query(spark, sf_dir):
    return runs.latest_step(runs.checkpoint_names(fixtures.listing(spark, sf_dir)))


@query("SELECT 'd' || max(user_id % 40) AS tag FROM events", name="largest_model")
def largest_query(spark, sf_dir):
    return runs.largest_model(runs.checkpoint_names(fixtures.listing(spark, sf_dir)))


@query("""
SELECT 'd' || (user_id % 40) AS tag, max(event_id) AS step FROM events
WHERE user_id % 40 = (SELECT max(user_id % 40) FROM events) GROUP BY ALL
""", name="resolve_checkpoint")
def resolve_query(spark, sf_dir):
    return runs.resolve_checkpoint(runs.checkpoint_names(fixtures.listing(spark, sf_dir)))


@query(f"""
WITH {LOG}
SELECT run_id % 8 AS n_layer, count(*) AS n_runs, sum(steps)::BIGINT AS n_steps, round(min(best), 6) AS min_val_bpb
FROM (SELECT run_id, max(step) AS steps, min(loss) AS best FROM log GROUP BY run_id) GROUP BY ALL
""", name="run_metadata")
def metadata_query(spark, sf_dir):
    """One metadata record per run, written as JSON and read back."""
    per_run = fixtures.step_log(spark, sf_dir).groupBy("run_id").agg(F.max("step").alias("step"), F.min("loss").alias("best"))
    given = {
        "step": F.col("step"), "val_bpb": F.col("best"), "n_layer": F.col("run_id") % 8, "min_val_bpb": F.col("best"),
    }

    def build(schema):
        return [
            (F.struct(*build(f.dataType)) if hasattr(f.dataType, "fields")
             else given.get(f.name, F.lit(0)).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]

    path = scratch_path(spark, "run-meta")
    run_metadata_write(per_run.select(*build(RUN_METADATA)), path)
    return run_metadata_read(spark, path).groupBy(F.col("model_config.n_layer").alias("n_layer")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("step").alias("n_steps"),
        rounded(F.min("loop_state.min_val_bpb")).alias("min_val_bpb"),
    )
