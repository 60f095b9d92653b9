import datetime
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillmill.operators import runs
from quillmill.sources.corpus import file_listing
from quillmill.sources.runs import run_metadata_read, run_metadata_write


@pytest.mark.parametrize("beta", [0.9, 0.5, 0.999])
def test_moving_average_matches_the_recurrence(spark, beta):
    """One run is long enough to cross several blocks."""
    rng = random.Random(1)
    rows = [("long", i, rng.uniform(-5, 5)) for i in range(5000)] + [("short", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, x double").repartition(4)
    got = {(r.run_id, r.step): r.out for r in runs.ema_debiased(df, "x", "out", beta=beta).collect()}
    smooth = {}
    for run, step, x in rows:
        smooth[run] = beta * smooth.get(run, 0.0) + (1 - beta) * x
        assert got[(run, step)] == pytest.approx(smooth[run] / (1 - beta ** (step + 1)), abs=1e-9)


def test_running_minimum_and_steps(spark):
    df = spark.createDataFrame([("a", 0, 3.0), ("a", 250, 5.0), ("a", 500, 1.0), ("a", 501, 0.5), ("b", 0, 9.0)],
                               "run_id string, step bigint, v double")
    evals = runs.every_n_steps(df)
    assert evals.count() == 4
    best = runs.running_min_val(evals, "v", "best").orderBy("run_id", "step").collect()
    assert [r.best for r in best] == [3.0, 3.0, 1.0, 9.0]


def test_step_metrics(spark):
    df = spark.createDataFrame([("a", 25, 2.0)], "run_id string, step bigint, dt_s double")
    row = runs.step_metrics(df, num_iterations=100, flops_per_token=6e9, world=2, batch_tokens=1001).first()
    assert row.pct_done == 25.0 and row.tok_per_sec == 500 and row.flops_so_far == 25 * 6e9 * 1001
    assert row.mfu == pytest.approx(100 * 6e9 * 1001 / 2 / (989e12 * 2))


def test_training_time(spark):
    df = spark.createDataFrame([("a", s, 1.5) for s in range(15)] + [("b", 3, 9.0)], "run_id string, step bigint, dt_s double")
    assert {r.run_id: r.total_time_s for r in runs.training_time(df).collect()} == {"a": 6.0, "b": 0.0}


def listing(spark, *paths):
    day = datetime.datetime(2024, 1, 1)
    rows = [(p, day + datetime.timedelta(days=i)) for i, p in enumerate(paths)]
    return runs.checkpoint_names(spark.createDataFrame(rows, "path string, mtime timestamp"))


def test_latest_step_is_a_number(spark):
    names = [f"c/d4/model_{s}.pt" for s in ("000009", "000010", "999999", "1000000")]
    found = listing(spark, *names, "c/d4/meta_2000000.json", "c/d4/optim_3000000_rank0.pt")
    assert [tuple(r) for r in runs.latest_step(found).collect()] == [("d4", 1000000)]


def test_largest_model(spark):
    assert runs.largest_model(listing(spark, "c/d4/model_1.pt", "c/d20/model_1.pt", "c/misc/model_9.pt")).first().tag == "d20"
    assert runs.largest_model(listing(spark, "c/misc/model_1.pt", "c/old/model_1.pt")).first().tag == "old"


def test_resolve(spark):
    found = listing(spark, "c/d4/model_000005.pt", "c/d20/model_000003.pt", "c/d20/model_000007.pt", "c/new/notes.txt")
    assert tuple(runs.resolve_checkpoint(found).first()) == ("d20", 7)
    assert tuple(runs.resolve_checkpoint(found, tag="d4").first()) == ("d4", 5)
    assert tuple(runs.resolve_checkpoint(found, step=3).first()) == ("d20", 3)
    for bad in (runs.resolve_checkpoint(found, tag="d9"), runs.resolve_checkpoint(found.limit(0)), runs.resolve_checkpoint(found, tag="new")):
        with pytest.raises(PySparkException, match="no checkpoints"):
            bad.collect()


def test_listing_of_files(spark, tmp_path):
    for name in ("d4/model_000001.pt", "d12/model_000002.pt", "d12/meta_000002.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = file_listing(spark, str(tmp_path)).withColumnRenamed("modificationTime", "mtime")
    assert tuple(runs.resolve_checkpoint(runs.checkpoint_names(files)).first()) == ("d12", 2)


def test_metadata(spark, tmp_path):
    record = {"step": 7, "val_bpb": 0.9, "model_config": {"n_layer": 4}, "dataloader_state_dict": {"pq_idx": 2, "rg_idx": 11},
              "loop_state": {"min_val_bpb": 0.8}}
    (tmp_path / "meta_000007.json").write_text(json.dumps(record))
    df = run_metadata_read(spark, str(tmp_path))
    want = (7, 4, 2, 11, 0.8, None)
    fields = ("step", "model_config.n_layer", "dataloader_state_dict.pq_idx", "dataloader_state_dict.rg_idx",
              "loop_state.min_val_bpb", "user_config.depth")
    assert tuple(df.select(*fields).first()) == want
    run_metadata_write(df, str(tmp_path / "copy"))
    assert tuple(run_metadata_read(spark, str(tmp_path / "copy")).select(*fields).first()) == want
    assert df.select(F.col("loop_state.smooth_train_loss")).first()[0] is None
