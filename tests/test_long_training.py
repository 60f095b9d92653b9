"""The registered long training: several forecasts and a rewrite of the words."""

from test_codec import library_merges, library_tokenizer

from quillmill.operators import bpe_training
from quillmill.plans import fixtures, token_queries


def test_long_training_equals_the_public_library(spark, monkeypatch):
    rewrites, apply = [], bpe_training.apply_merges
    monkeypatch.setattr(bpe_training, "apply_merges", lambda table, merges: rewrites.append(len(merges)) or apply(table, merges))
    folder = "/root/testdata/sf0.001"
    got = [(r["left_id"], r["right_id"]) for r in token_queries.bpe_train_512(spark, folder).orderBy("rank").collect()]
    docs = fixtures.corpus(spark, folder).select("shard", "text").collect()
    last = max(r["shard"] for r in docs)
    tok = library_tokenizer([r["text"][:10_000] for r in docs if r["shard"] != last and r["text"]], 265 + 512)
    assert len(got) == 512 and got == library_merges(tok)
    assert rewrites
