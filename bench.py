"""Time the headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillmill import catalog  # noqa: E402
from quillmill.operators.bpe_training import bpe_train  # noqa: E402
from quillmill.operators.vocabulary import merges_table  # noqa: E402
from quillmill.plans import stream_queries, token_queries  # noqa: E402
from quillmill.plans.corpus_queries import pieces_of_documents, train_words  # noqa: E402
from quillmill.session import build_session  # noqa: E402

HEADLINE = [
    "unigram_bpb_by_lang", "bits_per_byte", "pretoken_counts", "pretokenize", "adjacent_pair_counts", "bpe_encode",
    "bpe_decode", "pack_sequences", "next_token_targets", "running_chars", "char_budget", "compression_compare",
    "tool_call_spans", "render_conversation", "core_metric", "ema_debiased", "stream_tokenize", "stream_pack",
]

# Timed as they are, without the digests that the registered queries add for checking.


def vocab_1k(spark, sf_dir):
    return merges_table(spark, bpe_train(train_words(spark, sf_dir), 1024))


OPERATORS = {
    "pretokenize": pieces_of_documents,
    "stream_tokenize": stream_queries.tokenized_stream,
    "stream_pack": stream_queries.packed_stream,
    "bpe_train_1k": vocab_1k,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Training and encoding are timed apart from what builds on them.
    vocab, stored = token_queries.small_vocab(spark, sf_dir), token_queries.stored_ids(spark, sf_dir)
    apart = {
        "bpe_encode": lambda s, d: token_queries.encoded_documents(s, d, vocab),
        "bpe_decode": lambda s, d: token_queries.decoded_documents(s, d, vocab),
        "pack_sequences": lambda s, d: token_queries.packed_documents(s, d, stored),
        "bpe_train_256": lambda s, d: merges_table(s, token_queries.small_vocab(s, d)),
        "byte_ids": lambda s, d: token_queries.stored_ids(s, d),
    }
    timed = {name: catalog.QUERIES[name] for name in HEADLINE} | OPERATORS | apart
    if only:
        timed = {name: timed.get(name) or catalog.QUERIES[name] for name in only}
    for name in ("utf8_len", "tokenize_with"):  # start the session and the Python workers
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in timed.items():
        started = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
