"""Row groups as the files have them, the loader's state, and what is shuffled for packing."""

import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmill.operators.corpus import after_row_group
from quillmill.operators.packing import loader_state, pack_sequences
from quillmill.session import materialize
from quillmill.sources import row_groups
from quillmill.streaming.corpus import append_parquet


@pytest.fixture
def corpus(tmp_path):
    """Three files with row groups of uneven sizes, an unfinished and a hidden one."""
    rows = {}
    for name, sizes in {"shard_00000.parquet": [3, 5, 1, 4], "shard_00001.parquet": [2], "shard_00002.parquet": [1, 1, 1, 1, 1, 1, 6]}.items():
        at = 0
        with pq.ParquetWriter(tmp_path / name, pa.schema([("text", pa.string()), ("n", pa.int64()), ("wide", pa.string())])) as writer:
            for group, size in enumerate(sizes):
                table = pa.table({"text": [f"{name} {at + k}" for k in range(size)], "n": pa.array(range(size), pa.int64()), "wide": ["x" * 1000] * size})
                writer.write_table(table)
                rows.update({(name, at + k): group for k in range(size)})
                at += size
    (tmp_path / "shard_00003.parquet.tmp").write_bytes(b"unfinished")
    (tmp_path / "_hidden.parquet").write_bytes(b"no")
    return str(tmp_path), rows


@pytest.mark.parametrize("native", [True, False])
def test_stride_equals_the_footers(spark, corpus, monkeypatch, native):
    path, rows = corpus
    if not native:  # as for files only Spark can open
        os.remove(f"{path}/_hidden.parquet")
        monkeypatch.setattr(row_groups, "opens", lambda _: False)
    for rank in range(3):
        got = row_groups.row_group_scan(spark, path, "text string", rank, 3).collect()
        assert {(r["shard"], r["row"]): r["row_group"] for r in got} == {k: g for k, g in rows.items() if g % 3 == rank}
        assert all(r["text"] == f"{r['shard']} {r['row']}" for r in got)
    after = ("shard_00000.parquet", 2)
    left = [row_groups.row_group_scan(spark, path, "", rank, 3, after).collect() for rank in range(3)]
    want = {k for k, g in rows.items() if k[0] > after[0] or (k[0] == after[0] and g >= 3)}
    assert {(r["shard"], r["row"]) for part in left for r in part} == want and sum(map(len, left)) == len(want)


def test_one_partition_for_each_row_group_of_the_rank(spark, corpus):
    path, rows = corpus
    got = row_groups.row_group_scan(spark, path, "n bigint", 1, 3)
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("shard", "row_group").alias("n")).collect()
    assert [r["n"] for r in parts] == [1] * len({(s, g) for (s, _), g in rows.items() if g % 3 == 1})
    assert got.columns == ["shard", "row_group", "row", "n"]


def test_stream_goes_on_behind_the_last_row_group(spark, corpus, tmp_path):
    path, rows = corpus
    out = str(tmp_path / "out")
    late = pq.read_table(f"{path}/shard_00002.parquet")
    os.remove(f"{path}/_hidden.parquet")
    os.rename(f"{path}/shard_00002.parquet", f"{path}/shard_00002.later")
    counts = []
    for _ in range(2):
        stream = row_groups.row_group_stream(spark, path, "text string", 0, 3)
        append_parquet(stream, f"{out}/data", f"{out}/state").awaitTermination()
        counts.append(spark.read.parquet(f"{out}/data").count())
        if len(counts) == 1:
            os.rename(f"{path}/shard_00002.later", f"{path}/shard_00002.parquet")
    got = spark.read.parquet(f"{out}/data").collect()
    want = {k for k, g in rows.items() if g % 3 == 0}
    assert counts == [len([k for k in want if k[0] < "shard_00002"]), len(want)] and late.num_rows == 12
    assert len(got) == len(want) and {(r["shard"], r["row"]) for r in got} == want


def test_packing_gives_the_state_and_the_rest_is_read_after_it(spark):
    rows = [((k // 4) % 3, f"s{k // 40}", k % 40, (k % 40) // 4, list(range(k, k + 1 + k % 7))) for k in range(120)]
    docs = spark.createDataFrame(rows, "rank int, shard string, row long, row_group long, ids array<int>")
    packed = materialize(pack_sequences(docs, 2, 5), "packed")
    states = {(r["rank"], r["batch"]): (r["shard"], r["row_group"]) for r in loader_state(packed, 2).collect()}
    for rank in range(3):
        stream = [(s, g) for r, s, _, g, ids in sorted(rows, key=lambda r: (r[1], r[2])) if r == rank for _ in ids]
        want = {b: stream[b * 11 + 10] for b in range(len(stream) // 11)}
        assert {b: v for (r, b), v in states.items() if r == rank} == want
    shard, group = states[0, 3]
    left = {(r["shard"], r["row_group"]) for r in after_row_group(docs, shard, group, 3).collect()}
    assert left == {(s, g) for _, s, _, g, _ in rows if s > shard or (s == shard and g >= (group // 3 + 1) * 3)}


def test_one_exchange_carries_tokens(spark):
    docs = spark.range(5000).select(
        (F.col("id") % 3).cast("int").alias("rank"), F.lit("s").alias("shard"), "id", F.lit(0).alias("row_group"),
        F.sequence(F.lit(1), (F.col("id") % 50 + 1).cast("int")).alias("ids"),
    ).withColumnRenamed("id", "row").withColumn("n_ids", F.size("ids"))
    packed = pack_sequences(materialize(docs, "docs"), 4, 64)
    plan = packed._jdf.queryExecution().explainString(packed.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert len([e for e in exchanges if re.search(r"\b(ids|part|parts|seg|buf)#", e)]) == 1
