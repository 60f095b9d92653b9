"""Queries that do the whole job where a statement fixes less."""

from quillmill.functions.vocabulary import BYTE_TO_ID
from quillmill.plans import corpus_queries


def test_byte_symbols_of_the_last_source_and_of_the_end_of_a_long_text(spark, tmp_path):
    texts = [(0, "src0", "a" + " b" * 6000 + " fin"), (1, "src1", "val é"), (2, "src0", None)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"]: r["symbols"] for r in corpus_queries.symbols_query(spark, str(tmp_path)).collect()}
    want = ["a", " b", " fin", "val", " é"]
    assert got == {t: ",".join(str(BYTE_TO_ID[b]) for b in t.encode()) for t in want}
