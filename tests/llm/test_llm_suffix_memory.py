"""What a worker of the repeated passages holds, measured in this process."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from quillmill.llm import suffix_dedup


class Taken:
    """A table of which only the function over its partitions is wanted."""

    def same(self, *_):
        return self

    select = repartition = sortWithinPartitions = same

    def mapInArrow(self, fn, schema):  # noqa: N802
        return fn


def run(fn, batches):
    """(rows by column, peak of allocated MB); what has come out is not held by the function."""
    tracemalloc.start()
    out = [{name: column.to_pylist() for name, column in zip(b.schema.names, b.columns, strict=True)} for b in fn(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def held(texts, buckets=1):
    """(removed places of each text by its number, peaks of the steps by name)."""
    docs = pa.RecordBatch.from_pydict({"class": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    peaks = {}
    packed = list(suffix_dedup.anchor_rows(Taken(), 1)(iter([docs])))
    rows, peaks["shared"] = run(suffix_dedup.shared_places(Taken(), 1), packed)
    lists = [[] for _ in texts]
    for part in rows:
        for number, places in zip(part["class"], part["places"], strict=True):
            lists[number].append(places)
    some = [k for k, x in enumerate(lists) if x]
    wanted = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(some, pa.int64()), "text": pa.array([texts[k] for k in some]),
        "lists": pa.array([lists[k] for k in some], pa.list_(pa.binary())), "tag": pa.array(some, pa.int64()),
    })
    around = list(suffix_dedup.surroundings(Taken(), buckets)(iter([wanted])))
    if buckets > 1:
        whole = pa.Table.from_batches(around).sort_by("bucket")
        around = whole.combine_chunks().to_batches()
    rows, peaks["intervals"] = run(suffix_dedup.repeated_intervals(Taken(), 1), around)
    gone = {}
    for part in rows:
        for number, tag, low, high in zip(part["doc_id"], part["tag"], part["low"], part["high"], strict=True):
            assert tag == number
            gone.setdefault(number, set()).update(range(low, high))
    return gone, peaks


def brute(texts, length=50):
    first, gone = {}, {}
    for i, text in enumerate(texts):
        data = text.encode()
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k : k + length], i) < i:
                gone.setdefault(i, set()).update(range(k, k + length))
    return gone


def text(r, n):
    return "".join(r.choices("abcdefgh ", k=n))


def test_a_passage_of_very_many_documents():
    r = random.Random(3)
    line = text(r, 78)
    texts = [text(r, r.randint(0, 45)) + line + text(r, r.randint(0, 45)) for _ in range(25_000)]
    gone, peaks = held(texts)
    assert gone == brute(texts)
    assert len(gone) > 24_000
    print(peaks)
    assert peaks["intervals"] < 150


def test_many_passages_of_two_documents():
    r = random.Random(4)
    passages = [text(r, 120) for _ in range(9_000)]
    order = [k % 9_000 for k in range(18_000)]
    r.shuffle(order)
    texts = ["".join(passages[k] + text(r, 7) for k in order[n : n + 6]) for n in range(0, len(order), 6)]
    gone, peaks = held(texts)
    assert gone == brute(texts)
    print(peaks)
    assert peaks["intervals"] < 150
    assert held(texts, 7)[0] == gone


def test_hashes_and_anchors_a_step_at_a_time(monkeypatch):
    r = np.random.default_rng(5)
    sizes = np.array([0, 30, 700, 0, 49, 50, 51, 3000, 0])
    data = r.integers(97, 101, int(sizes.sum())).astype(np.uint8)
    starts = np.cumsum(sizes) - sizes
    low = np.sort(r.integers(0, len(data) - 72, 500))
    high = low + r.integers(1, 72, 500)
    whole = suffix_dedup.anchors_of(data, starts, sizes), suffix_dedup.hashes_of(data, low, high)
    for step in (1, 60, 999):
        monkeypatch.setattr(suffix_dedup, "STEP_BYTES", step)
        assert suffix_dedup.anchors_of(data, starts, sizes).tolist() == whole[0].tolist()
        assert suffix_dedup.hashes_of(data, low, high).tolist() == whole[1].tolist()


def test_small_steps_give_the_same_rows(monkeypatch):
    r = random.Random(6)
    shared = [text(r, n) for n in (49, 50, 51, 90, 260)] + ["ab" * 60, "é" * 40, "a" * 70]
    texts = ["".join(r.choice([text(r, r.randint(0, 40)), r.choice(shared)]) for _ in range(7)) for _ in range(40)]
    texts = [t for t in dict.fromkeys(texts) if len(t.encode()) >= 50] + ["a" * 500, "a" * 400, "ab" * 90]
    want = brute(texts)
    for name, value in (("STEP_BYTES", 300), ("STEP_BYTES", 72), ("STEP_PLACES", 5), ("HELD_BYTES", 1), ("BATCH_BYTES", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
        assert held(texts)[0] == want
        assert held(texts, 5)[0] == want


def test_texts_are_cut_a_few_at_a_time():
    r = random.Random(7)
    texts = [text(r, 9_990) + f"{k:010d}" for k in range(3_000)]
    spans = [[{"low": 100, "high": 150}, {"low": 140, "high": 300}] if k % 2 else None for k in range(3_000)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(3_000), pa.int64()), "n_bytes": pa.array([10_000] * 3_000, pa.int64()), "digest": pa.array([str(k) for k in range(3_000)]),
        "whole": pa.array([k % 10 == 4 for k in range(3_000)]), "text": pa.array(texts),
        "intervals": pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
    })
    table = Taken()
    table.schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType())])
    fn, n = suffix_dedup._cut(table, []), 0
    tracemalloc.start()
    for part in fn(iter([batch])):
        for row, shown in zip(part.select(["doc_id", "digest", "n_removed"]).to_pylist(), part.column("kept_text"), strict=True):
            assert row["doc_id"] == n and row["digest"] == str(n)
            assert row["n_removed"] == (200 if n % 2 else 10_000 if n % 10 == 4 else 0)
            assert shown.as_py() == (texts[n][:100] + texts[n][300:] if n % 2 else "" if n % 10 == 4 else texts[n])
            n += 1
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 3_000
    print(peak)
    assert peak < 20
