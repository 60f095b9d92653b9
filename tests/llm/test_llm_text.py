"""Token counts, BPE, id files, packing and decision lists against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import best_fit, byte_bpe, decision_lists, prefix_counts, seekable
from quillmill.llm.codes import Encoder
from quillmill.llm.words import safe_pieces

VOCABULARY, RANKS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = [
    " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "l", "L", "é", "1", "²", "!", "$", "<|endoftext|>", "　", "\x1c", "\x85",
    "世界", "🌍", "՘", "'d", "a", " the", "\xa0", "aaaaaaaa", "------------", "ing",
]
CASES = [
    (1, None), (2, ""), (3, "   \n"), (4, "The same text, twice."), (5, "The same text, twice."), (6, "x<|endoftext|>y  z"),
    (None, "no id"), (7, "word " * 3000), (8, "a" * 9000), (9, "don't we'll  they've\n\n\nnaïve 世界 12345"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, with extra columns of clashing names."""
    rows = [(i, t, "ids", 7) for i, t in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def made_up(n, size, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, size))) for _ in range(n)]


def expected(library, texts):
    return [np.array(e.ids, "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_library(library):
    texts = made_up(4000, 25)
    assert [i.tolist() for i in Encoder(VOCABULARY).encode(texts).each()] == [i.tolist() for i in expected(library, texts)]


def test_prefix_counts_equal_library_at_every_prefix(library):
    counter = prefix_counts.counter(VOCABULARY)
    for k, text in enumerate(made_up(300, 14, 2)):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert counter.prefixes(text).tolist() == want
        counts, fits = prefix_counts.count_texts(counter, [text], k % 9)
        assert counts == [want[-1] if want else 0]
        assert fits == [max([0] + [i + 1 for i, n in enumerate(want) if n <= k % 9])]


def test_token_counts(docs, library):
    got = prefix_counts.token_counts(docs, VOCABULARY, 100)
    assert got.columns == ["doc_id", "ids", "n_tokens", "fit_chars"]
    want = {i: len(e) for (i, _), e in zip(CASES, expected(library, [t for _, t in CASES]), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want
    assert prefix_counts.token_counts(docs.limit(0), VOCABULARY, 100).count() == 0
    kept = prefix_counts.prefix_counts(docs, VOCABULARY)
    assert {r["doc_id"]: (r["prefix_tokens"] or [0])[-1] for r in kept.collect()} == want


def test_rank_codec_round_trip(docs):
    import tiktoken

    ranks = byte_bpe.codec(RANKS, tokenizers.PATTERN).encoding._mergeable_ranks
    library = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.encode_and_decode(docs, RANKS, tokenizers.PATTERN).collect()}
    assert len(got) == len(CASES)
    for doc_id, text in CASES:
        assert bytes(got[doc_id]["decoded"]) == (text or "").encode()
        assert np.frombuffer(got[doc_id]["ids"], "<u4").tolist() == library.encode_ordinary(text or "")
    apart = byte_bpe.decode(byte_bpe.encode(docs, RANKS, tokenizers.PATTERN), RANKS, tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in apart.collect()} == {i: (t or "").encode() for i, t in CASES}
    assert byte_bpe.encode(docs.limit(0), RANKS, tokenizers.PATTERN).count() == 0


def test_long_texts_are_cut_where_nothing_crosses():
    codec = byte_bpe.codec(RANKS, tokenizers.PATTERN)
    text = "".join(made_up(300, 400, 3)).replace("<|endoftext|>", "")
    assert len(text) > byte_bpe.PIECE_CHARS
    assert codec.encode(text).tolist() == codec.encoding.encode_ordinary(text)
    for limit in (1, 7, 50):
        assert "".join(safe_pieces(text[:2000], limit)) == text[:2000]
    assert codec.decode(np.array([129], np.uint32)) == codec.encoding.decode_bytes([129])  # not UTF-8 by itself


def test_id_files(docs, spark, library, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = seekable.write_ids(docs, VOCABULARY, partitions=3, folder=folder, file_bytes=600)
    files = manifest.collect()
    assert len(files) > 2
    rows = seekable.read_ids(spark, manifest).collect()
    ordered = sorted(CASES, key=lambda c: (c[0] is not None, c[0] or 0))
    ids = {i: np.append(e, np.uint32(0)) for (i, _), e in zip(CASES, expected(library, [t for _, t in CASES]), strict=True)}
    start = 0
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id, _ in ordered:
        assert by_id[doc_id]["start"] == start
        assert np.frombuffer(by_id[doc_id]["ids"], "<u4").tolist() == ids[doc_id].tolist()
        start += len(ids[doc_id])
    found = dict(seekable.lookup(files, {5, 9}))
    assert {k: v.tolist() for k, v in found.items()} == {k: ids[k].tolist() for k in (5, 9)}
    digests = {r["doc_id"]: r["ids_crc32"] for r in seekable.read_ids(spark, manifest, digest=True).collect()}
    assert digests == {k: zlib.crc32(v.astype("<u4").tobytes()) for k, v in ids.items()}
    empty = seekable.write_ids(docs.limit(0), VOCABULARY, partitions=2)
    assert seekable.read_ids(spark, empty).count() == 0


def test_damaged_frame_is_found(tmp_path):
    import pyarrow as pa

    with open(tmp_path / "f", "wb") as file:
        writer = seekable.FrameWriter(file)
        writer.add(4, np.arange(100, dtype=np.uint32))
        writer.add(None, np.arange(3, dtype=np.uint32))
        writer.close()
    data = bytearray((tmp_path / "f").read_bytes())
    reader = seekable.FrameReader(pa.BufferReader(bytes(data)))
    assert reader.document(1).tolist() == [0, 1, 2] and reader.doc_ids.tolist() == [4, seekable.NULL_ID]
    data[12] ^= 255
    with pytest.raises(Exception):  # noqa: B017  the decompressor's error or the checksum's
        seekable.FrameReader(pa.BufferReader(bytes(data))).document(0)


def brute_fullest(counts, room):
    best = {0}
    for length, n in counts.items():
        best = {s + k * length for s in best for k in range(n + 1) if s + k * length <= room}
    return max(best)


def test_fullest_combination():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(0, 6))}
        room = r.randint(0, 60)
        found = best_fit.fullest(counts, room)
        assert all(0 < times <= counts[length] for length, times in found)
        assert sum(length * times for length, times in found) == brute_fullest(counts, room)


def test_packing(docs, spark, library):
    capacity = 64
    pieces = best_fit.encode_pieces(docs, VOCABULARY, capacity)
    rows = best_fit.pack(pieces, capacity).collect()
    ids = {i: np.append(e, np.uint32(0)).astype("<u4") for (i, _), e in zip(CASES, expected(library, [t for _, t in CASES]), strict=True)}
    places, parts = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and bytes(r["ids"]) == part.tobytes()
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for spots in places.values():
        spots.sort()
        assert [s for s, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= capacity
    for doc_id, cuts in parts.items():
        cuts.sort()
        assert sum(n for _, _, n in cuts) == len(ids[doc_id])
        assert all(n == capacity for _, _, n in cuts[1:])
    assert len(places) <= -(-sum(map(len, ids.values())) // capacity) + 1
    assert best_fit.pack(best_fit.encode_pieces(docs.limit(0), VOCABULARY), 2048).count() == 0
    many = spark.range(5000).select((F.col("id") % 3 + 20).alias("length"), F.lit(1).alias("extra"))
    packed = best_fit.pack(many, 63)
    assert packed.count() == 5000 and packed.select("sequence_id").distinct().count() <= 1668


def base_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(docs, spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "b ", " ", "\n", "c# ", "é|", "\x0b", "x y z "]) for _ in range(r.randint(0, 80))) for _ in range(150)]
    made = spark.createDataFrame([(100 + k, t, "e", 1) for k, t in enumerate(texts)], docs.schema)
    everything = {i: t for i, t in CASES} | {100 + k: t for k, t in enumerate(texts)}
    rows = decision_lists.judge(docs.unionByName(made), []).collect()
    assert len(rows) == len(everything)
    for row in rows:
        n = base_statistics(everything[row["doc_id"]])
        assert tuple(row[c] for c in decision_lists.BASE) == n
        assert row["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert row["kept"] == (not row["base_failed"])


def test_rules_are_learned(spark, docs):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        bad = k % 3 == 0
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) + ("$$" if bad and r.random() < 0.7 else "") for _ in range(80)]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = decision_lists.fit(table, marks)
    assert rules and all(rules)
    kept = {x["doc_id"]: x["kept"] for x in decision_lists.judge(table, rules).collect()}
    assert kept == {k: q == 1 for k, q in labels}
    assert decision_lists.fit(table, marks.limit(0)) == []
    assert decision_lists.judge(docs.limit(0), rules).count() == 0


def test_digest_columns(spark):
    """The registered query's digests on a table of its own."""
    from quillmill.llm import queries

    got = queries.op8_byte_bpe(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
