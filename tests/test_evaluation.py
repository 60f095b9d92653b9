import math
import random
import time
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillmill.functions import logits as lg
from quillmill.functions import sequences as sq
from quillmill.functions.text import strip
from quillmill.functions.vocabulary import BYTE_LEVEL
from quillmill.operators import evaluation as ev
from quillmill.operators import sampling, scoring
from quillmill.operators.vocabulary import token_bytes_table
from quillmill.sources import items as files


def items(spark, n=12, task="t"):
    return spark.createDataFrame([(task, i, f"text {i}") for i in range(n)], "task string, item_id bigint, text string")


def test_fewshot_draws_are_distinct_others(spark):
    shuffled = sampling.seeded_shuffle(items(spark).unionByName(items(spark, 5, "u")))
    assert sorted(r.idx for r in shuffled.filter("task = 't'").collect()) == list(range(12))
    for k in (1, 4):
        rows = sampling.fewshot_sample(shuffled, k).collect()
        assert len(rows) == 17 * k
        for task, n in (("t", 12), ("u", 5)):
            for idx in range(n):
                picked = [r.other_idx for r in rows if r.task == task and r.idx == idx]
                assert len(set(picked)) == k and idx not in picked and all(0 <= p < n for p in picked)
    gathered = sampling.fewshot_gather(shuffled, sampling.fewshot_sample(shuffled, 2), ["item_id", "text"])
    assert all(len(r.shots) == 2 and all(s.text == f"text {s.item_id}" for s in r.shots) for r in gathered.collect())


def test_fewshot_limits(spark):
    shuffled = sampling.seeded_shuffle(items(spark, 3))
    none = sampling.fewshot_gather(shuffled, sampling.fewshot_sample(shuffled, 0), ["text"])
    assert all(r.shots == [] for r in none.collect())
    assert sampling.fewshot_sample(shuffled, 2).count() == 6
    with pytest.raises(PySparkException, match="too few"):
        sampling.fewshot_sample(shuffled, 3).collect()
    assert sampling.limit_per_task(shuffled, 0).count() == 3 and sampling.limit_per_task(shuffled, 2).count() == 2


def test_draws_cover_all_sets_evenly(spark):
    drawn = sampling.fewshot_sample(sampling.seeded_shuffle(items(spark, 600)), 2)
    spread = drawn.groupBy("other_idx").count().agg(F.max("count"), F.count("*")).first()
    assert spread[0] < 12 and spread[1] > 450


def test_strip(spark):
    df = spark.createDataFrame([(" \t\n a b  \n",), ("   ",), ("x",), ("a\x1f",)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "", "x", "a"]


ITEM = ("task string, idx int, task_type string, delimiter string, query string, choices array<string>, gold int, "
        "context_options array<string>, context string, continuation string, "
        "shots array<struct<query:string,choices:array<string>,gold:int,context_options:array<string>,context:string,continuation:string>>")


def test_prompts(spark):
    rows = [
        ("t", 0, ev.MC, " ", "Q", ["a", "b"], 1, None, None, None, [("q1", ["x", "y"], 1, None, None, None)]),
        ("t", 1, ev.SCHEMA, " ", None, None, 0, ["c1", "c2"], None, "end", [(None, None, 0, ["o1", "o2"], None, "e1")]),
        ("t", 2, ev.LM, ": ", None, None, None, None, " ctx \n", "go ", [(None, None, None, None, " s \n", "t")]),
        ("t", 3, ev.MC, " ", "Q", ["a"], 0, None, None, None, []),
    ]
    got = {r.idx: r.prompts for r in ev.render_prompts(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {
        0: ["q1 y\n\nQ a", "q1 y\n\nQ b"], 1: ["o1 e1\n\nc1 end", "o1 e1\n\nc2 end"],
        2: ["s: t\n\nctx:", "s: t\n\nctx: go "], 3: ["Q a"],
    }
    with pytest.raises(PySparkException, match="unsupported task type"):
        ev.render_prompts(spark.createDataFrame([("t", 0, "other", " ", *[None] * 6, [])], ITEM)).collect()


@pytest.mark.parametrize("seqs, prefix, suffix", [
    ([[1, 2, 3], [1, 2, 4]], 2, 0), ([[1, 2], [1, 2, 3]], 2, 0), ([[1, 2], [1, 2]], 2, 2), ([[5, 2], [1, 2], [7, 7, 2]], 0, 1),
    ([[1]], 1, 1), ([[], [1]], 0, 0), ([[1, 2, 9], [1, 3, 9], [1, 2, 9]], 1, 1),
])
def test_common_lengths(spark, seqs, prefix, suffix):
    df = spark.createDataFrame([(seqs,)], "s array<array<int>>")
    assert df.select(sq.common_prefix_len(F.col("s")), sq.common_suffix_len(F.col("s"))).first() == (prefix, suffix)


def test_spans(spark):
    schema = "idx int, task_type string, seqs array<array<int>>"
    rows = [(0, ev.MC, [[0, 1, 2], [0, 1, 3, 4]]), (1, ev.SCHEMA, [[0, 1, 9, 9], [0, 2, 2, 9, 9]]), (2, ev.LM, [[0, 1], [0, 1, 2]]),
            (3, ev.LM, [[0, 5], [0, 1, 2]]), (4, ev.LM, [[0, 1], [0, 1]]), (5, ev.MC, [[0, 1], [0, 1, 3]])]
    good, bad = ev.continuation_spans(spark.createDataFrame(rows, schema))
    spans = {r.idx: [(s.option, s.start_at, s.end_at) for s in r.spans] for r in good.collect()}
    assert spans == {0: [(0, 2, 3), (1, 2, 4)], 1: [(0, 2, 4), (1, 3, 5)], 2: [(0, 2, 3)], 5: [(0, 2, 2), (1, 2, 3)]}
    assert {r.idx for r in bad.collect()} == {3, 4}
    targets = ev.span_targets(good, ["idx"]).orderBy("idx", "option", "pos").collect()
    assert [tuple(r) for r in targets if r.idx == 0] == [(0, 0, 1, 1, 2), (0, 1, 1, 1, 3), (0, 1, 2, 3, 4)]
    assert [tuple(r) for r in targets if r.idx == 5] == [(5, 0, None, None, None), (5, 1, 1, 1, 3)]


def test_crop_spans(spark):
    schema = "idx int, task_type string, seqs array<array<int>>"
    good, _ = ev.continuation_spans(spark.createDataFrame([(0, ev.MC, [[0, 1, 2, 3, 4, 7], [0, 1, 2, 3, 4, 8, 9]])], schema))
    assert [(s.seq, s.start_at, s.end_at) for s in ev.crop_spans(good, 6).first().spans] == [
        ([0, 1, 2, 3, 4, 7], 5, 6), ([1, 2, 3, 4, 8, 9], 4, 6)]
    with pytest.raises(PySparkException, match="crop cut"):
        ev.crop_spans(good, 1).collect()


def test_pad_and_halves(spark):
    df = spark.createDataFrame([([[1], [1, 2, 3], []],)], "s array<array<int>>")
    assert df.select(sq.pad_right(F.col("s"), 0)).first()[0] == [[1, 0, 0], [1, 2, 3], [0, 0, 0]]


def test_ties_and_empty_spans(spark):
    losses = spark.createDataFrame(
        [(0, 1, 2.0), (0, 0, 2.0), (1, 0, None), (1, 1, 9.0), (2, 0, 3.0), (2, 1, 1.0)], "idx int, option int, mean_loss double")
    assert {r.idx: r.picked for r in ev.pick_option(losses, ["idx"]).collect()} == {0: 0, 1: 1, 2: 1}


def test_mean_loss_does_not_depend_on_row_order(spark):
    rng = random.Random(0)
    losses = [rng.uniform(0, 12) for _ in range(300)]
    rows = [(0, option, x) for option in range(4) for x in rng.sample(losses, len(losses))]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "idx int, option int, nats double").repartition(parts, "nats")
        means = ev.option_mean_loss(df, ["idx"])
        assert means.select("mean_loss").distinct().count() == 1
        assert means.first().mean_loss == pytest.approx(sum(losses) / 300)
        assert ev.pick_option(means, ["idx"]).first().picked == 0


def test_mean_loss_of_odd_values(spark):
    rows = [(0, 0, float("nan")), (0, 0, 1.0), (0, 1, 50.0), (0, 2, None), (0, 3, float("inf"))]
    means = ev.option_mean_loss(spark.createDataFrame(rows, "idx int, option int, nats double"), ["idx"])
    got = {r.option: r.mean_loss for r in means.collect()}
    assert math.isnan(got[0]) and got[1] == 50.0 and got[2] is None and got[3] == float("inf")
    assert ev.pick_option(means, ["idx"]).first().picked == 1


def test_decisions(spark):
    scores = spark.createDataFrame(
        [("t", 0, 0, 1.0, 5, 5), ("t", 0, 1, 0.5, 6, 5), ("t", 1, 0, 1.0, 5, 5), ("t", 1, 0, 1.0, 5, 6), ("t", 2, 0, 9.0, 7, 7)],
        "task string, idx int, option int, nats double, target_id int, pred_id int")
    kinds = spark.createDataFrame([("t", 0, ev.MC, 1), ("t", 1, ev.LM, None), ("t", 2, ev.LM, None)],
                                  "task string, idx int, task_type string, gold int")
    decided = ev.decide_items(scores, kinds, ["task", "idx"])
    assert {r.idx: r.correct for r in decided.collect()} == {0: True, 1: False, 2: True}
    assert ev.task_accuracy(decided).first()[1:] == (2 / 3, 3)


def test_report(spark, tmp_path):
    results = spark.createDataFrame([("a", 0.625, 3), ("b", 0.5, 1)], "task string, accuracy double, n_items bigint")
    base = spark.createDataFrame([("a", 25.0), ("b", 50.0)], "task string, baseline double")
    report = ev.report_with_total(ev.centered_accuracy(results, base))
    files.eval_report_sink(report, str(tmp_path / "r"))
    lines = [p.read_text() for p in (tmp_path / "r").glob("*.csv")][0].splitlines()
    assert lines[0] == "Task,Accuracy,Centered"
    assert sorted(lines[1:]) == ["CORE,,0.250000", "a,0.625000,0.500000", "b,0.500000,0.000000"]
    assert ev.missing_baselines(results, base.filter("task = 'a'")).first().task == "b"
    assert ev.duplicate_labels(results.unionByName(results.limit(1))).count() == 1


def test_item_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(
        '{"query": "q", "choices": ["a", "b"], "gold": 1}\n{"context": "c", "continuation": "d"}\n'
        '{"context_options": ["x", "y"], "gold": 0, "continuation": "z"}\n')
    got = files.task_items_scan(spark, str(tmp_path / "t.jsonl"))
    assert got.count() == 3 and got.filter("query = 'q'").first().choices == ["a", "b"]
    (tmp_path / "tasks.json").write_text('{"label": "a", "icl_task_type": "schema", "dataset_uri": "u", "num_fewshot": [3, 5]}\n')
    assert tuple(files.task_table(spark, str(tmp_path / "tasks.json")).first()) == ("a", "schema", "u", 3, " ")
    (tmp_path / "b.csv").write_text("Eval Task,Other,Random baseline\na,1,25\n")
    assert tuple(files.baseline_scan(spark, str(tmp_path / "b.csv")).first()) == ("a", 25.0)


# --- scores -----------------------------------------------------------------------


def test_bits_per_byte(spark):
    table = token_bytes_table(spark, BYTE_LEVEL)
    scores = spark.createDataFrame([("a", 10, 2.0), ("a", 11, 1.0), ("a", 0, 50.0), ("a", -1, 70.0), ("b", 0, 1.0), ("b", -1, 1.0)],
                                   "g string, target_id int, nats double")
    got = {r.g: (r.nats, r.n_bytes, r.bpb) for r in scoring.bits_per_byte(scores, table, ["g"]).collect()}
    assert got["a"][:2] == (3.0, 2) and got["a"][2] == pytest.approx(3 / (math.log(2) * 2))
    assert got["b"] == (0.0, 0, float("inf"))
    assert scoring.bits_per_byte(scores.limit(0), table).first().bpb == float("inf")


def test_bigram_scores(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1), (2, 0)], "token_id int, target_id int")
    counts, heads = scoring.bigram_scorer(pairs)
    targets = spark.createDataFrame([(1, 2), (1, 9), (7, 1), (1, -1)], "prev_id int, target_id int")
    for vocab_size in (10, 5000):  # broadcast and shuffled
        got = {(r.prev_id, r.target_id): (r.nats, r.pred_id) for r in scoring.ngram_scores(targets, counts, heads, vocab_size).collect()}
        assert got[(1, 2)] == (pytest.approx(-math.log(3 / (3 + vocab_size))), 2)
        assert got[(1, 9)][0] == pytest.approx(-math.log(1 / (3 + vocab_size)))
        assert got[(7, 1)] == (pytest.approx(-math.log(1 / vocab_size)), 0) and got[(1, -1)][0] is None
    assert heads.filter("prev_id = 2").first().pred_id == 0


@pytest.mark.parametrize("heavy_share", [0.0, 0.02, 2.0])
def test_heavy_pairs_do_not_change_scores(spark, heavy_share):
    rng = random.Random(4)
    draw = lambda: min(int(rng.paretovariate(0.5)), 32_000)
    pairs = spark.createDataFrame([(draw(), draw()) for _ in range(3000)], "token_id int, target_id int")
    counts, heads = scoring.bigram_scorer(pairs)
    targets = spark.createDataFrame([(i, draw(), draw()) for i in range(3000)], "i int, prev_id int, target_id int")
    got = scoring.ngram_scores(targets, counts, heads, 32_768, heavy_share).select("i", "nats", "pred_id").orderBy("i").collect()
    n, total, best = Counter(map(tuple, pairs.collect())), Counter(), {}
    for (prev, target), k in n.items():
        total[prev] += k
        best[prev] = max(best.get(prev, (0, 0)), (k, -target))
    for row, (i, prev, target) in zip(got, targets.collect(), strict=True):
        assert row.nats == pytest.approx(-math.log((n[prev, target] + 1) / (total[prev] + 32_768)))
        assert row.pred_id == -best.get(prev, (0, 0))[1]


@pytest.mark.parametrize("max_tokens", [1, 8, 1000])
def test_score_with_any_model(spark, max_tokens):
    rng = random.Random(2)
    seqs = [(1, [5, 6, 7]), (2, [5]), (3, None), (4, []), (5, [9] * 40)]
    seqs += [(i, [rng.randrange(50) for _ in range(rng.randrange(9))]) for i in range(6, 60)]
    df = spark.createDataFrame(seqs, "seq_id bigint, ids array<int>").coalesce(2)

    def make():
        def score(ids, lengths):
            assert ids.shape[0] == len(lengths) and ids.shape[1] == lengths.max() > 1
            assert ids.size <= max_tokens or len(lengths) == 1
            assert all((row[n:] == 99).all() for row, n in zip(ids, lengths))
            return ids[:, :-1] / 2, ids[:, :-1] + 1
        return score

    scored = scoring.score_with(df, make, "seq_id", max_tokens=max_tokens, pad_id=99)
    got = {r.seq_id: (r.target_ids, r.nats, r.pred_ids) for r in scored.collect()}
    assert got == {k: ((s or [])[1:], [x / 2 for x in (s or [])[:-1]], [x + 1 for x in (s or [])[:-1]]) for k, s in seqs}
    rows = scoring.score_rows(scored, "seq_id").filter("seq_id = 1").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 6, 2.5, 6), (1, 1, 7, 3.0, 7)]


def test_predictions_against_targets_in_a_row(spark):
    rows = [
        (1, [7, 8, 9, 4], [8, 9, 0, 1], 2, 4), (2, [7, 8, 9, 4], [8, 0, 4], 1, 4), (3, [7, 8], [8, 8], 2, 2),
        (4, [7, 8, 9], [8, 9, 1], 0, 9), (5, None, [1], 1, 1), (6, [1], None, None, None), (7, [], [], 1, 5),
    ]
    df = spark.createDataFrame(rows, "k int, ids array<int>, pred_ids array<int>, start_at int, end_at int")
    got = {r.k: [tuple(s) for s in r.steps] for r in ev.join_prediction_target(df).collect()}
    assert got == {
        1: [(1, 9, 9, True), (2, 0, 4, False)], 2: [(0, 8, 8, True), (1, 0, 9, False), (2, 4, 4, True)], 3: [],
        4: [(0, 8, 8, True), (1, 9, 9, True)], 5: [], 6: [], 7: [],
    }


def test_logits(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0, -2.0], 1), (1, [0.0, 0.0], -1)], "k int, l array<double>, y int")
    row = df.select("k", lg.argmax(F.col("l")).alias("a"), lg.cross_entropy(F.col("l"), F.col("y")).alias("ce")).orderBy("k").collect()
    total = sum(math.exp(x) for x in (1, 3, 3, -2))
    assert row[0].a == 1 and row[0].ce == pytest.approx(-math.log(math.exp(3) / total)) and row[1].ce is None
    first = df.filter("k = 0")
    assert [t.token for t in first.select(lg.topk(F.col("l"), 2)).first()[0]] == [1, 2]
    assert [t.token for t in first.select(lg.topk(F.col("l"), 1, keep_ties=True)).first()[0]] == [1, 2]
    assert [t.token for t in first.select(lg.topk(F.col("l"), 99)).first()[0]] == [1, 2, 0, 3]
    probs = [t.prob for t in first.select(lg.softmax(lg.topk(F.col("l"), 3), 2.0)).first()[0]]
    assert sum(probs) == pytest.approx(1) and probs[0] == probs[1] == pytest.approx(math.e ** 0.5 * math.e / (2 * math.e ** 1.5 + math.e ** 0.5))
    with pytest.raises(ValueError):
        lg.weighted_draw(F.col("l"), F.col("k"), 1, temperature=-1)
    assert first.select(lg.weighted_draw(lg.topk(F.col("l"), 4), F.col("k"), 1, temperature=0)).first()[0] == 1


def test_draws_follow_the_weights(spark):
    df = spark.range(4000).select("id", F.array(F.lit(0.0), F.lit(math.log(3.0))).alias("l"))
    share = df.select(lg.weighted_draw(lg.topk(F.col("l"), 2), F.col("id"), 42).alias("t")).agg(F.avg("t")).first()[0]
    assert 0.72 < share < 0.78
    assert df.repartition(7).select("id", lg.weighted_draw(lg.topk(F.col("l"), 2), F.col("id"), 42).alias("t")).exceptAll(
        df.select("id", lg.weighted_draw(lg.topk(F.col("l"), 2), F.col("id"), 42).alias("t"))).count() == 0


def test_a_task_without_one_baseline_is_an_error(spark):
    results = spark.createDataFrame([("a", 0.5, 4), ("b", 0.25, 4)], "task string, accuracy double, n_items int")
    for rows in ([("a", 25.0)], [("a", 25.0), ("b", 25.0), ("b", 50.0)]):
        base = spark.createDataFrame(rows, "task string, baseline double")
        with pytest.raises(PySparkException, match="baseline for task b"):
            ev.core_metric(ev.centered_accuracy(results, base)).collect()


def test_an_item_without_scores_is_an_error(spark):
    items = spark.createDataFrame([("t", 0, ev.LM, None), ("t", 1, ev.LM, None)], "task string, idx int, task_type string, gold int")
    scores = spark.createDataFrame([("t", 0, 0, 1.0, 5, 5)], "task string, idx int, option int, nats double, pred_id int, target_id int")
    with pytest.raises(PySparkException, match="no scores for item t 1"):
        ev.decide_items(scores, items, ["task", "idx"]).collect()


def test_logits_of_a_whole_vocabulary_are_linear(spark):
    """32,768 logits a row: seconds for all rows, where evaluating a part anew for each
    element would take hours."""
    rows = spark.range(20).select("id", F.transform(F.sequence(F.lit(0), F.lit(32767)), lambda i: F.sin(i * (F.col("id") + 1))).alias("v")).persist()
    rows.count()
    started = time.perf_counter()
    capped = lg.softcap(F.col("v"))
    best = lg.topk(F.col("v"), 20, keep_ties=True)
    out = rows.select(
        lg.cross_entropy(capped, F.lit(7)).alias("nats"), F.size(lg.softmax(best)).alias("k"),
        F.aggregate(lg.softmax(best), F.lit(0.0), lambda a, r: a + r["prob"]).alias("mass"),
    ).collect()
    assert (time.perf_counter() - started) / 20 < 0.5
    assert all(r.k >= 20 and abs(r.mass - 1) < 1e-9 and 0 < r.nats < 40 for r in out)
    mean = rows.select(lg.mean_cross_entropy(F.col("v"), F.when(F.col("id") < 5, 3).otherwise(-1)).alias("m")).first().m
    each = rows.where("id < 5").select(lg.cross_entropy(F.col("v"), F.lit(3)).alias("n")).collect()
    assert math.isclose(mean, sum(r.n for r in each) / 5)


def test_mean_loss_of_large_values_ties_in_any_order(spark):
    values = [1e9 / 7, 3e8 / 11, 1e17, 0.1, 2e8 / 13, 1e-9, 5e11 / 3]
    rows = [(k, v) for k in range(6) for v in values[k:] + values[:k]] + [(10, 1.7e308), (10, 1.7e308), (11, 1e17), (11, 1.0), (11, -1e17)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, nats double").groupBy("k").agg(ev.mean_loss().alias("m")).collect()}
    assert len({got[k] for k in range(6)}) == 1
    assert got[10] == 1.7e308 and got[11] == 1 / 3
