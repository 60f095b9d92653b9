"""Steps that several parts of a query need are made once."""

from pyspark.sql import functions as F

from quillmill.functions.vocabulary import BYTE_LEVEL, BYTE_TO_ID, Vocabulary
from quillmill.operators import compression
from quillmill.operators import evaluation as ev
from quillmill.plans import evaluation_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_made_once_for_the_query(spark, tmp_path):
    texts = [(0, "s", "a" * 30), (1, "s", "short"), (2, "s", None), (3, "s", "0123456789ab"), (4, "s", "0123456789"), (5, "s", "0123456789a")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = evaluation_queries.prediction_query(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [(0, 20, 20), (3, 2, 0), (5, 1, 0)]
    assert "Filter (size(coalesce" not in plan(df)
    assert plan(df).lower().count("zip_with") == 0


def test_predictions_of_odd_rows(spark):
    rows = [
        (0, [1, 2, 3, 4], [1, 2, 2, None], 1, 4), (1, None, [1, 2], 1, 2), (2, [1, 2], None, 1, 2), (3, [1, 2, 3], [5, 3], 2, 9),
        (4, [], [], 0, 0), (5, [7, 7, 7], [7, None, 7], None, None), (6, [1, 2], [2], -3, 2),
    ]
    df = spark.createDataFrame(rows, "k int, pred_ids array<int>, ids array<int>, start_at int, end_at int")
    got = {r["k"]: [tuple(s) for s in r["steps"]] for r in ev.join_prediction_target(df).collect()}
    assert got == {
        0: [(0, 1, 2, False), (1, 2, 2, True), (2, 3, None, None)], 1: [], 2: [], 3: [], 4: [],
        5: [(0, 7, None, None), (1, 7, 7, True)], 6: [],
    }
    assert ev.join_prediction_target(df).columns == [*df.columns, "steps"]


def test_statistics_are_made_once_for_both_sides(spark):
    docs = spark.createDataFrame([("x", "abab"), ("x", None), ("y", "b"), (None, "ab")], "name string, text string")
    small = Vocabulary(((BYTE_TO_ID[97], BYTE_TO_ID[98], 265),))
    stats = compression.compression_stats(docs, {"bytes": BYTE_LEVEL, "bpe": small})
    sides = compression.join_tokenizer_results(stats, "bytes", "bpe")
    assert sorted(tuple(r) for r in sides.collect()) == [("x", 4, 1.0, 2, 2.0), ("y", 1, 1.0, 1, 1.0)]
    assert "ids_of_pieces" in plan(stats) and "ids_of_pieces" not in plan(sides)
    twice = stats.unionByName(stats.filter(F.col("tokenizer") == "bpe"))
    assert compression.join_tokenizer_results(twice, "bytes", "bpe").count() == 4
