"""Words and phrases that hashes or filters used to mix up."""

import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
from tokenizers import Tokenizer

from quillmill.llm import best_fit, decision_lists, minhash_dedup, prefix_counts, seekable
from quillmill.llm.codes import Encoder
from quillmill.llm.shingles import shingle_sets, word_hashes, word_runs
from quillmill.llm.words import WordTable

VOCABULARY = tokenizers.path("byte_bpe_50k.json")


def thue_morse(a, b, size=1024):
    """Two words whose sums of powers of an odd base are equal modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


PAIRS = [thue_morse(*letters) for letters in ("ab", "ez", "xq")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("pair", PAIRS)
def test_words_of_equal_sums_are_told_apart(library, pair):
    want = [library.encode(w, add_special_tokens=False).ids for w in pair]
    assert want[0] != want[1]
    assert [i.tolist() for i in Encoder(VOCABULARY).encode(list(pair)).each()] == want
    coder = Encoder(VOCABULARY)
    for w, ids in [*zip(pair, want, strict=True)] * 2:  # also with the other one kept from before
        assert coder.encode([w]).flat.tolist() == ids
    counter = prefix_counts.PrefixCounter(VOCABULARY)
    assert prefix_counts.count_texts(counter, list(pair), 9)[0] == [len(i) for i in want]
    assert [prefix_counts.count_texts(counter, [w], 9)[0][0] for w in pair] == [len(i) for i in want]
    one, other = ("a b c d " + w for w in pair)
    assert not set(shingle_sets([one])[0]) & set(shingle_sets([other])[0])


def test_any_hash_tells_words_apart(monkeypatch):
    """With hashes of two values only, a number still stands for one word."""
    coder = Encoder(VOCABULARY)
    r = random.Random(5)
    table = WordTable(10_000)
    of_number = {}
    for _ in range(20):
        words = coder.splitter.split([" ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "fff"]) for _ in range(30))])
        words.hashes = words.hashes % np.uint64(2)
        numbers, _ = table.numbers_of(words)
        for i, number in enumerate(numbers.tolist()):
            assert of_number.setdefault(number, words.word(i)) == words.word(i)
    assert len(set(of_number.values())) >= 6


def test_word_hashes_follow_the_bytes():
    r = random.Random(2)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 300))) for _ in range(3000)]
    data = np.frombuffer((" ".join(words) + " " * 9).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    hashes = word_hashes(data, ends - [len(w) for w in words], ends).tolist()
    by_hash = {}
    for w, h in zip(words, hashes, strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(set(hashes)) == len(set(words))


def test_hash_sets_and_word_runs_agree():
    r = random.Random(3)
    texts = ["", " \t", "One", "a B c d", *(" ".join(r.choice("aAbcd") for _ in range(r.randint(1, 60))) for _ in range(200))]
    assert [len(s) for s in shingle_sets(texts)] == [len(word_runs(t)) for t in texts]


def test_links_are_confirmed_on_words():
    texts = ["a b c d e f", "a b c d e f g", "p q r s t u"]
    linked = ~np.eye(3, dtype=bool)  # as if all hashes were equal
    assert minhash_dedup.confirmed(linked, texts, (50, 100)) == [(0, 1)]


def test_documents_with_such_words_do_not_link(spark):
    fill = " ".join(f"w{k}" for k in range(4))
    rows = [(k, f"{fill} {w}") for k, w in enumerate(w for pair in PAIRS for w in pair)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_sequences_and_files_with_such_words(spark, library):
    rows = [(k, w) for k, w in enumerate(w for pair in PAIRS for w in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {k: [*library.encode(w, add_special_tokens=False).ids, 0] for k, w in rows}
    files = seekable.read_ids(spark, seekable.write_ids(docs, VOCABULARY)).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in files} == want
    got = {}
    for s in best_fit.write_sequences(docs, VOCABULARY, 100).collect():
        ids = np.frombuffer(s["ids"], "<u2")
        assert len(ids) <= 100
        for p in s["pieces"]:
            got.setdefault(p["doc_id"], []).append((p["piece"], ids[p["offset"] : p["offset"] + p["length"]].tolist()))
    assert {k: [t for _, part in sorted(v) for t in part] for k, v in got.items()} == want


def test_filters_on_a_verdict_do_not_repeat_the_statistics(spark):
    plain = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame(
        [(1, plain + " a b c x a b c y", 5, "mine"), (2, "p q r s " * 200, 6, "mine"), (3, None, 7, "mine")], "doc_id long, text string, h int, `row.c0` string"
    )
    judged = decision_lists.judge(docs, [[decision_lists.Condition("repeat_rate", True, 0.9)]])
    assert [r["doc_id"] for r in judged.where("kept").select("doc_id").collect()] == [1]
    assert {(r["doc_id"], r["h"], r["row.c0"]) for r in judged.where("n_words >= 0").collect()} == {(1, 5, "mine"), (2, 6, "mine"), (3, 7, "mine")}
    plan = judged.where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_learned_list_by_hand():
    """One threshold tells the bad rows, a second the rest of them; order and coverage are known."""
    values = np.array([[1.0, k % 7] for k in range(30)] + [[0.0, 9.0]] * 30 + [[0.0, k % 7] for k in range(60)])
    bad = np.array([True] * 60 + [False] * 60)
    rules = decision_lists.learn(values, bad, ["a", "b"])
    covered = [decision_lists.covered(rule, values, ["a", "b"]) for rule in rules]
    assert len(rules) == 2
    assert sorted(c.sum() for c in covered) == [30, 30] and not (covered[0] & covered[1]).any()
    assert all(bad[c].all() for c in covered)
    assert {str(rule[0]) for rule in rules} == {"a >= 0.5", "b >= 7.5"}
