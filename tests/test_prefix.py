import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators.prefix import BLOCK, dense_index, ranged, running_total, shuffled_position


def hot_rows(seed=0, n=400):
    """Two thirds of the rows share one group and shard; row numbers have gaps."""
    rng = random.Random(seed)
    rows = set()
    while len(rows) < n:
        hot = rng.random() < 0.66
        rows.add(("g0" if hot else rng.choice("ab"), "s1" if hot else rng.choice(["s0", "s1", "s2"]), rng.randrange(2000)))
    return [(*key, rng.randrange(1, 50)) for key in sorted(rows)]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("op", ["sum", "min", "max"])
@pytest.mark.parametrize("by, major", [([], "s"), (["g"], "s"), (["g", "s"], None)])
def test_running_total_matches_a_plain_loop(spark, by, major, op, inclusive):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, s string, row bigint, v bigint")
    if not by:
        df = df.dropDuplicates(["s", "row"])
        rows = [tuple(r) for r in df.collect()]
        df = spark.createDataFrame(rows, df.schema)
    got = {(r.g, r.s, r.row): r.out for r in running_total(
        df, F.col("v"), "out", by=by, major=major, op=op, inclusive=inclusive, block=64).collect()}
    fold = {"sum": sum, "min": min, "max": max}[op]
    for g, s, row, _ in rows:
        def before(o):
            same = (not by or o[0] == g) and (major or o[1] == s)
            place, mine = ((o[1], o[2]), (s, row)) if major else (o[2], row)
            return same and (place < mine or (inclusive and place == mine))
        values = [o[3] for o in rows if before(o)]
        assert got[(g, s, row)] == (fold(values) if values else (0 if op == "sum" else None))


def test_dense_index_and_block_size_do_not_matter(spark):
    df = spark.createDataFrame([("a", r * 7) for r in range(50)], "s string, row bigint")
    assert [r.i for r in dense_index(df, "i", major="s").orderBy("row").collect()] == list(range(50))
    sizes = [running_total(df, F.lit(1), "n", major="s", block=b).orderBy("row").collect() for b in (1, 10, 100000)]
    assert sizes[0] == sizes[1] == sizes[2]


def test_shuffled_position_is_a_permutation_in_hash_order(spark):
    df = spark.createDataFrame([("t", i) for i in range(300)] + [("u", 1)], "task string, item bigint")
    out = shuffled_position(df, F.md5(F.col("item").cast("string")), "idx", by=["task"], tie="item", buckets=7)
    rows = sorted((r.idx, r.item) for r in out.filter("task = 't'").collect())
    import hashlib
    want = sorted(range(300), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    assert [item for _, item in rows] == want and [idx for idx, _ in rows] == list(range(300))


def test_rows_with_null_keys_stay(spark):
    rows = [("a", "s", 0, 1), (None, "s", 1, 2), (None, "s", 2, 3)]
    df = spark.createDataFrame(rows, "g string, s string, row bigint, v bigint")
    got = {r.row: r.out for r in running_total(df, F.col("v"), "out", by=["g"], major="s").collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    shuffled = shuffled_position(df, F.md5(F.col("row").cast("string")), "p", ["g"], "row").collect()
    assert sorted((r.g or "", r.p) for r in shuffled) == [("", 0), ("", 1), ("a", 0)]


def test_ranges_follow_the_number_of_rows_not_their_values(spark):
    n, gap = 100_000, 10_000
    df = spark.range(n).select(F.lit("s").alias("s"), (F.col("id") * gap).alias("row"), F.lit("x").alias("payload"))
    rows = ranged(df.select("s", "row"), ["s", "row"])
    sizes = sorted(r["count"] for r in rows.groupBy("_range").count().collect())
    assert -(-n // BLOCK) / 2 <= len(sizes) <= 2 * -(-n // BLOCK) and sizes[-1] <= 2 * BLOCK
    got = dense_index(df, "i", major="s")
    assert got.columns == ["s", "row", "payload", "i"]
    assert got.where(F.col("i") * gap != F.col("row")).count() == 0 and got.count() == n
