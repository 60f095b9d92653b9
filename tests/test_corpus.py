import pytest
from pyspark.sql import functions as F

from quillmill.operators.corpus import (
    after_row_group,
    char_budget,
    doc_crop,
    shard_stride,
    train_val_split,
    with_rank,
    with_row_group,
)
from quillmill.operators.packing import next_token_targets, pack_sequences, repeat_epochs
from quillmill.sources.corpus import (
    corpus_scan,
    download_summary,
    file_listing,
    missing_shards,
    shard_manifest,
    split_files,
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three shards of ten documents, an unfinished file and a second column."""
    path = tmp_path_factory.mktemp("corpus")
    import pyarrow as pa
    import pyarrow.parquet as pq

    for s in range(3):
        texts = [f"doc {s}-{i}" for i in range(10)]
        pq.write_table(pa.table({"text": texts, "other": list(range(10))}), path / f"shard_{s:05d}.parquet", row_group_size=2)
    (path / "shard_00003.parquet.tmp").write_bytes(b"partial")
    return str(path)


def test_scan_reads_only_what_is_asked_for(spark, folder):
    df = corpus_scan(spark, folder)
    assert df.columns == ["shard", "row", "text"] and df.count() == 30
    rows = df.filter("shard = 'shard_00001.parquet'").orderBy("row").collect()
    assert [r.text for r in rows] == [f"doc 1-{i}" for i in range(10)] and [r.row for r in rows] == list(range(10))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string," in plan and "other" not in plan


@pytest.mark.parametrize("split_by", [train_val_split, split_files])
def test_last_file_is_validation(spark, folder, split_by):
    df = corpus_scan(spark, folder)
    assert {r.shard for r in split_by(df, "val").collect()} == {"shard_00002.parquet"}
    assert split_by(df, "train").count() == 20
    with pytest.raises(ValueError):
        split_by(df, "test")


def test_one_shard_has_no_train_split(spark):
    df = spark.createDataFrame([("only", 0, "x")], "shard string, row bigint, text string")
    assert train_val_split(df, "train").count() == 0 and train_val_split(df, "val").count() == 1


def test_stride_matches_file_row_groups(spark, folder):
    df = with_row_group(corpus_scan(spark, folder), 2, dense=True)
    mine = shard_stride(df, 1, 2).filter("shard = 'shard_00000.parquet'").orderBy("row").collect()
    assert [r.row for r in mine] == [2, 3, 6, 7]
    counted = with_row_group(corpus_scan(spark, folder), 2)
    assert sorted(counted.collect()) == sorted(df.collect())


def test_resume_skips_to_the_next_stride(spark, folder):
    df = with_rank(with_row_group(corpus_scan(spark, folder), 2, dense=True), 2)
    rest = after_row_group(df, "shard_00001.parquet", 1, world=2)
    seen = {(r.shard[-9], r.row_group) for r in rest.collect()}
    assert seen == {("1", 2), ("1", 3), ("1", 4)} | {("2", g) for g in range(5)}


@pytest.mark.parametrize("limit, kept", [(0, 1), (2, 1), (3, 2), (6, 2), (7, 3), (8, 3), (100, 4)])
def test_budget_keeps_the_document_that_crosses(spark, limit, kept):
    # lengths 3, 4 | 5, 1 over two shards
    df = spark.createDataFrame(
        [("a", 0, "xxx"), ("a", 5, "xxxx"), ("b", 0, "xxxxx"), ("b", 1, "x")], "shard string, row bigint, text string")
    before, want = 0, 0
    for n in (3, 4, 5, 1):
        want += before <= limit
        before += n
    assert char_budget(df, limit).count() == want
    if limit < 100:
        assert want == kept


def test_budget_of_nothing(spark):
    assert char_budget(spark.createDataFrame([], "shard string, row bigint, text string"), 10).count() == 0


def test_crop_counts_characters_and_casts(spark):
    df = spark.createDataFrame([("🌍你好x",)], "text string")
    assert doc_crop(df, 2).first().text == "🌍你"
    assert doc_crop(spark.createDataFrame([(12345,)], "text int"), 3).first().text == "123"


def test_manifest(spark, folder):
    listing = file_listing(spark, folder)
    assert listing.filter(F.col("name").endswith(".tmp")).count() == 1
    manifest = shard_manifest(spark, 5)
    assert [r.name for r in missing_shards(manifest, listing).orderBy("name").collect()] == ["shard_00003.parquet", "shard_00004.parquet"]
    assert download_summary(manifest, listing).first() == (3, 5)
    assert shard_manifest(spark).count() == shard_manifest(spark, 99999).count() == 1823


# --- packing ----------------------------------------------------------------------


def packed(df, **kw):
    rows = pack_sequences(df, **kw).orderBy("rank", "batch", "row_in_batch").collect()
    return [(r["rank"], r["batch"], r["row_in_batch"], r["inputs"], r["targets"]) for r in rows]


def by_hand(docs, batch_size, seq_len, overlap):
    out, width = [], batch_size * seq_len + 1
    for rank in sorted({d[0] for d in docs}):
        stream = [t for d in sorted(docs) if d[0] == rank for t in d[3]]
        stride, b = (width - 1 if overlap else width), 0
        while b * stride + width <= len(stream):
            part = stream[b * stride: b * stride + width]
            for r in range(batch_size):
                cut = slice(r * seq_len, (r + 1) * seq_len)
                out.append((rank, b, r, part[:-1][cut], part[1:][cut]))
            b += 1
    return out


PACK_SCHEMA = "rank int, shard string, row bigint, ids array<int>"


def test_small_packing_case(spark):
    docs = [(0, "a", 0, [0, 1, 2, 3, 4]), (0, "a", 1, [0, 5]), (0, "b", 0, [0] + list(range(6, 15)))]
    got = packed(spark.createDataFrame(docs, PACK_SCHEMA), batch_size=2, seq_len=3)
    assert got == by_hand(docs, 2, 3, False) and len(got) == 4
    assert got[0][3:] == ([0, 1, 2], [1, 2, 3])


@pytest.mark.parametrize("overlap", [False, True])
@pytest.mark.parametrize("batch_size, seq_len", [(1, 1), (2, 3), (3, 50)])
def test_packing_matches_a_plain_loop(spark, overlap, batch_size, seq_len):
    import random

    rng = random.Random(3)
    docs = [(0 if rng.random() < 0.7 else rng.randrange(3), rng.choice("ab"), i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 7, 180]))])
            for i in range(60)]
    df = spark.createDataFrame(docs, PACK_SCHEMA).repartition(5)
    got = packed(df, batch_size=batch_size, seq_len=seq_len, overlap=overlap)
    assert got == by_hand(docs, batch_size, seq_len, overlap)
    limited = packed(df, batch_size=batch_size, seq_len=seq_len, overlap=overlap, limit_batches=2)
    assert limited == [row for row in got if row[1] < 2]


def test_epochs_follow_one_another(spark):
    docs = [(0, "a", 0, [1, 2, 3]), (0, "b", 0, [4, 5])]
    twice = repeat_epochs(spark.createDataFrame(docs, PACK_SCHEMA), 2)
    got = packed(twice, batch_size=1, seq_len=4)
    assert [row[3:] for row in got] == [([1, 2, 3, 4], [2, 3, 4, 5]), ([1, 2, 3, 4], [2, 3, 4, 5])]


def test_next_token_targets(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, [5]), (3, [])], "k int, ids array<int>")
    rows = [tuple(r) for r in next_token_targets(df).orderBy("k", "pos").collect()]
    assert rows == [(1, 0, 5, 6), (1, 1, 6, 7)]


def test_no_epochs_are_an_error(spark):
    with pytest.raises(ValueError):
        repeat_epochs(spark.createDataFrame([("a", 0)], "shard string, row bigint"), 0)


def test_budget_stops_reading(spark):
    """Lengths past the shard that crosses the budget are never computed."""
    rows = [(f"s{k:02d}", r, "x" * 10) for k in range(32) for r in range(3)]
    df = spark.createDataFrame(rows, "shard string, row bigint, text string")
    guarded = F.when(F.col("shard") < "s07", F.length("text")).otherwise(F.raise_error(F.lit("read too far")).cast("int"))
    kept = char_budget(df, 75, guarded).collect()  # groups of 1, 2 and 4 shards
    assert [(r.shard, r.row) for r in sorted(kept)][-1] == ("s02", 1) and len(kept) == 8
