"""Streaming queries over a table that is a folder of files, as large tables are, or one file."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmill.functions.vocabulary import BYTE_TO_ID
from quillmill.plans import stream_queries

DOCS = [(i, "ab é"[: i % 5], f"src{i % 3}", i % 5) for i in range(40)] + [(40, None, "src0", None)]
SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(params=[1, 5])
def folder(request, spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).repartition(request.param).write.parquet(f"{tmp_path}/table")
    if request.param > 1:
        (tmp_path / "table").rename(tmp_path / "documents.parquet")
    else:
        part, = (tmp_path / "table").glob("part-*.parquet")
        part.rename(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "x")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_stream_of_documents(spark, folder):
    got = {r["source"]: (r["n_docs"], r["n_chars"]) for r in stream_queries.stream_query(spark, folder).collect()}
    sizes = {s: [d[3] for d in DOCS if d[2] == s] for s in ("src0", "src1", "src2")}
    assert got == {s: (len(v), sum(n or 0 for n in v)) for s, v in sizes.items()}


def test_tokens_of_streamed_documents(spark, folder):
    rows = stream_queries.tokenize_query(spark, folder).orderBy("doc_id").collect()
    digest = lambda t: hashlib.md5(",".join(map(str, [0, *(BYTE_TO_ID[b] for b in t.encode())])).encode()).hexdigest()
    assert [tuple(r) for r in rows] == [(i, digest(t)) for i, t, _, _ in DOCS if t is not None]
    assert stream_queries.tokenized_stream(spark, folder).filter(F.col("ids").isNull()).count() == 0
