import datetime
import random
import time

import pytest

from quillmill.functions.vocabulary import BYTE_LEVEL, BYTE_TO_ID
from quillmill.operators.packing import pack_sequences
from quillmill.operators.scoring import bits_per_byte
from quillmill.operators.vocabulary import token_bytes_table
from quillmill.streaming import chat
from quillmill.streaming import corpus as streams

PACK_SCHEMA = "rank int, shard string, row bigint, ids array<int>"


def drop_files(spark, rows, schema, path, sizes):
    """Write rows as one file after another."""
    at = 0
    for n in sizes:
        spark.createDataFrame(rows[at: at + n], schema).coalesce(1).write.mode("append").parquet(path)
        at += n
        time.sleep(0.02)


@pytest.mark.parametrize("overlap", [False, True])
def test_stream_packing_equals_batch(spark, tmp_path, overlap):
    rng = random.Random(5)
    docs = [(0 if i % 3 else i % 2, f"s{i // 10}", i, [rng.randrange(99) for _ in range(rng.choice([1, 4, 30]))]) for i in range(30)]
    docs += [(7, "s9", 99, [1, 2])]  # a rank that never fills a batch
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    drop_files(spark, docs, PACK_SCHEMA, path, [12, 1, 10, 8])
    source = streams.corpus_stream(spark, path, PACK_SCHEMA, max_files=1)
    streams.stream_pack(source, out, state, 2, 4, overlap=overlap).awaitTermination()
    # restart with more input: what was carried goes on
    drop_files(spark, [(0, "t", 0, list(range(40)))], PACK_SCHEMA, path, [1])
    streams.stream_pack(streams.corpus_stream(spark, path, PACK_SCHEMA, max_files=1), out, state, 2, 4, overlap=overlap).awaitTermination()
    want = pack_sequences(spark.createDataFrame(docs + [(0, "t", 0, list(range(40)))], PACK_SCHEMA), 2, 4, overlap=overlap)
    order = ("rank", "batch", "row_in_batch")
    columns = (*order, "inputs", "targets")
    got = streams.read_batches(spark, out).select(*columns).orderBy(*order).collect()
    assert got == want.select(*columns).orderBy(*order).collect() and len(got) > 20


def test_restart_reads_only_what_is_left(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([(1, "a"), (2, "bc")], [(3, None), (4, "d")]):
        drop_files(spark, part, "k int, text string", path, [len(part)])
        stream = streams.stream_tokenize(streams.corpus_stream(spark, path, "k int, text string"))
        streams.append_parquet(stream.select("k", "ids"), out, state).awaitTermination()
    rows = {r.k: r.ids for r in spark.read.parquet(out).collect()}
    assert rows == {1: [0, BYTE_TO_ID[97]], 2: [0, BYTE_TO_ID[98], BYTE_TO_ID[99]], 4: [0, BYTE_TO_ID[100]]}
    assert spark.read.parquet(out).count() == 3


def test_stream_bits_per_byte_equals_batch(spark, tmp_path):
    rows = [("x" if i % 3 else "y", i % 40, float(i)) for i in range(60)]
    schema, path = "g string, target_id int, nats double", str(tmp_path / "in")
    drop_files(spark, rows, schema, path, [20, 20, 20])
    table = token_bytes_table(spark, BYTE_LEVEL)
    running = streams.stream_bpb(streams.corpus_stream(spark, path, schema, max_files=1), table, ["g"])
    streams.keep_latest(running, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = bits_per_byte(spark.createDataFrame(rows, schema), table, ["g"])
    got = {r.g: (r.nats, r.n_bytes, r.bpb) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.g: (r.nats, r.n_bytes, r.bpb) for r in want.collect()}


def ids(text):
    return [BYTE_TO_ID[b] for b in text.encode()]


def test_chat_context(spark, tmp_path):
    schema, path = "conv_id bigint, turn bigint, role string, text string", str(tmp_path / "in")
    rows = [
        (1, 0, "user", " hi \n"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"),
        (1, 2, "user", "   "), (1, 3, "user", "CLEAR"), (1, 4, "assistant", "lost"), (2, 1, "assistant", "b"),
        (1, 5, "user", "new"), (1, 6, "assistant", "ok"), (1, 7, "user", "quit"), (1, 8, "user", "late"), (1, 9, "assistant", "x"),
        (2, 2, "system", "s"), (2, 3, "user", "exit now"),
    ]
    drop_files(spark, rows, schema, path, [3, 4, 3, 4])
    events = chat.chat_events(streams.corpus_stream(spark, path, schema, max_files=1))
    streams.append_parquet(chat.stream_chat_context(events), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    messages = spark.createDataFrame(rows, schema)
    added = chat.placed_events(spark.read.parquet(str(tmp_path / "out")), chat.chat_events(messages))
    got = {(r.conv_id, r.turn): (r.segment, r.start) for r in added.collect()}
    assert got == {(1, 0): (0, 1), (1, 1): (0, 6), (1, 5): (1, 1), (1, 6): (1, 7), (2, 0): (0, 1), (2, 1): (0, 5), (2, 3): (0, 7)}
    contexts = {(r.conv_id, r.segment): r.ids for r in chat.chat_contexts(added).collect()}
    assert contexts[(1, 0)] == [0, 1, *ids("hi"), 2, 3, *ids("yo"), 4]
    assert contexts[(1, 1)] == [0, 1, *ids("new"), 2, 3, *ids("ok"), 4]
    assert contexts[(2, 0)] == [0, 1, *ids("a"), 2, 3, *ids("b"), 4, 1, *ids("exit now"), 2, 3]


def chat_places(spark, tmp_path, rows, schema, sizes, **options):
    path = str(tmp_path / "in")
    drop_files(spark, rows, schema, path, sizes)
    keep = [c for c in ("at",) if "at " in schema]
    events = chat.chat_events(streams.corpus_stream(spark, path, schema, max_files=1), keep=keep)
    places = chat.stream_chat_context(events, **options)
    streams.append_parquet(places, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_chat_turns_over_micro_batches_in_any_order(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [
        (c, t, role, text) for c in range(4) for t, (role, text) in enumerate([
            ("system", "s"), ("user", "one"), ("assistant", "two"), ("user", " "), ("user", "clear"), ("user", "three" * c),
            ("assistant", "four"), ("user", "quit"), ("user", "late"),
        ])
    ]
    in_order = chat_places(spark, tmp_path / "a", rows, schema, [36])
    random.Random(3).shuffle(rows)
    again = [rows[0], rows[9], (1, None, "user", "no turn")]  # two repeated, one without turn
    assert chat_places(spark, tmp_path / "b", rows + again, schema, [7, 11, 1, 17, 3]) == in_order
    assert {p[:2] for p in in_order if p[0] == 1} == {(1, 1), (1, 2), (1, 5), (1, 6)}


def test_idle_chats_expire(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string, at timestamp"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [
        (1, 0, "user", "a", at(0)), (1, 2, "user", "bc", at(1)),  # turn 1 never comes
        (2, 0, "user", "quit", at(1)),
        (3, 0, "user", "x", at(30)), (4, 0, "user", "x", at(50)),
    ]
    got = chat_places(spark, tmp_path, rows, schema, [2, 1, 1, 1], at="at", idle="5 minutes", late="0 seconds")
    assert got == [(1, 0, 0, 1), (1, 2, 0, 5), (3, 0, 0, 1), (4, 0, 0, 1)]
    held = spark.read.format("statestore").option("stateVarName", "place").load(str(tmp_path / "state"))
    assert {r["key"]["conv_id"] for r in held.select("key").collect()} == {4}  # conversations 1, 2 and 3 are gone
