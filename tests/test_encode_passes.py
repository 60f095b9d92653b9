"""Batches are encoded in runs of rows whose texts are bounded, so a batch of long texts takes little more memory
than its texts."""

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.functions import codec
from quillmill.functions.vocabulary import BYTE_LEVEL, BYTE_TO_ID, Vocabulary
from quillmill.operators import vocabulary

ROWS = [None, ["ab", " ab"], [], [""], ["x" * 40], ["é"], None, ["ab"] * 9]
SMALL = Vocabulary(((BYTE_TO_ID[97], BYTE_TO_ID[98], 265),))


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_passes_keep_all_rows_in_order(monkeypatch, limit):
    monkeypatch.setattr(codec, "BYTES_PER_PASS", limit)
    rows = pa.array([["skipped"], *ROWS], pa.list_(pa.string())).slice(1)
    for batch in (rows, pa.array([None, ROWS, [], [None]], pa.list_(rows.type)), rows.slice(0, 0), pa.array([[], None], rows.type)):
        parts = list(codec._passes(batch))
        assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    sizes = [[sum(map(len, "".join(r or []).encode("utf-8").split(b"\0"))) for r in p.to_pylist()] for p in codec._passes(rows)]
    assert all(sum(s) <= limit or len(s) == 1 or sum(s[1:]) == 0 for s in sizes)


def test_ids_do_not_depend_on_passes():
    rows = pa.array(ROWS, pa.list_(pa.string()))
    whole = codec._encode_lists(rows, codec.PieceEncoder(SMALL))
    assert whole.to_pylist()[1] == [265, BYTE_TO_ID[32], 265] and whole.to_pylist()[0] is None
    apart = [i for n in range(len(rows)) for i in codec._encode_lists(rows.slice(n, 1), codec.PieceEncoder(SMALL)).to_pylist()]
    assert apart == whole.to_pylist()


def test_memory_of_a_batch_of_long_texts():
    batch = pa.array([["%07d" % i * 500] for i in range(8000)], pa.list_(pa.string()))
    run = codec._ids_function(BYTE_LEVEL).func
    tracemalloc.start()
    before, rows = pa.total_allocated_bytes(), 0
    for ids in run(iter([batch])):
        rows += len(ids)
        assert pa.total_allocated_bytes() - before < 64 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 8000 and peak < 256 << 20


def test_tokenizer_gets_runs_of_texts(spark, monkeypatch):
    texts = [None, "aa", "", "b" * 50, "aa", None, "c"] * 3
    want = [None if t is None else list(t.encode()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = vocabulary.tokenize_with(df, lambda: lambda t: list(t.encode()))
    assert [r["ids"] for r in got.orderBy("k").collect()] == want
    monkeypatch.setattr(vocabulary, "CHARS_PER_PASS", 10)
    parts = list(vocabulary.by_size(pd.Series(texts, dtype=object)))
    assert len(parts) > 3 and pd.concat(parts).tolist() == texts
    assert list(vocabulary.by_size(pd.Series([None, None], dtype=object)))[0].tolist() == [None, None]


def test_nested_texts_of_several_passes(spark):
    rows = [(i, [f"{i}" * 300_000, None, ""] if i % 3 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, texts array<string>").coalesce(1)
    got = df.select("k", F.transform(codec.bpe_encode_each(F.col("texts")), lambda x: F.size(x)).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == [[300_000 * len(str(i)), None, 0] if i % 3 else None for i in range(12)]
