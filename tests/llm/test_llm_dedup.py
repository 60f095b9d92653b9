"""Near copies, vectors, components and repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import embedding_dedup, minhash_dedup, suffix_dedup
from quillmill.llm.components import components
from quillmill.llm.shingles import shingle_sets
from quillmill.llm.suffix_array import adjacent_common, suffix_array


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 540)] + [(1, 1)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for p in links if p[0] != p[1] for n in p}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_texts():
    """Families of edited copies, chains, exact copies and edge cases."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(5))
    texts = [None, "", " \n ", "one two", "ONE two", "one two three four", "É a b c d e", "é a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 120))]
        texts += [" ".join(base)] * r.choice([1, 2, 5])
        for _ in range(r.randint(1, 6)):
            edited = list(base)
            for _ in range(r.choice([1, 1, 2, 3])):
                edited[r.randrange(len(edited))] = word()
            texts.append("  ".join(edited).upper() if r.random() < 0.2 else " ".join(edited))
            base = edited if r.random() < 0.5 else base
    texts.append(" ".join(word() for _ in range(20_000)))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_shingles():
    texts = [t or "" for _, t in near_texts()]
    sets = shingle_sets(texts)
    for text, found in zip(texts, sets, strict=True):
        assert len(found) == len(word_set(text))
    for a in range(0, len(texts), 3):
        for b in range(a, len(texts), 7):
            assert len(np.intersect1d(sets[a], sets[b])) == len(word_set(texts[a]) & word_set(texts[b]))


@pytest.mark.parametrize("block", [minhash_dedup.BLOCK, 3])
def test_near_documents(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)  # 3: buckets of several blocks
    rows = near_texts()
    sets = {i: word_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    want = roots(sets, links)
    table = spark.createDataFrame([(i, t, "x", 3) for i, t in [*rows, (None, "without an id")]], "doc_id long, text string, node string, a int")
    got = minhash_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows) + 1
    for row in got:
        i = row["doc_id"]
        if i is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert minhash_dedup.near_duplicates(table.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    limits = minhash_dedup.least_equal(0.75, 1e-6)
    assert limits[0][0] == minhash_dedup.BATCH and all(m < 0.75 * n for n, m in limits)
    r = np.random.default_rng(2)
    left = r.integers(0, 1 << 16, (2000, minhash_dedup.HASHES)).astype(np.uint16)
    right = np.where(r.random(left.shape) < 0.75, left, left + np.uint16(1))
    kept = [minhash_dedup.promising(left[k : k + 1], right[k : k + 1], 0.75, 1e-6)[0, 0] for k in range(2000)]
    assert np.mean(kept) > 0.999
    assert not minhash_dedup.promising(left[:300], left[:300] + np.uint16(1), 0.75, 1e-6).any()


def vector_rows():
    r = np.random.default_rng(6)
    rows = []
    for label in (0, 1, 2):
        for _ in range(12):
            base = r.standard_normal(16)
            for _ in range(int(r.integers(1, 7))):
                rows.append(((base + r.standard_normal(16) * r.choice([0.0, 0.05, 0.2, 0.4])).tolist(), label))
    rows += [(rows[0][0], 0)] * 40 + [(rows[0][0], 1), (rows[0][0], None)]
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None] * 8, 1), ([float("inf")] * 16, 0), ([1.0, 2.0], 0)]
    return [(k, v, label) for k, (v, label) in enumerate(rows)]


def test_vectors(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], "vec_id long, embedding array<double>, label int, node string, copies int")
    good = {
        k: np.array(v) for k, v, label in rows
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
    }
    labels = {k: label for k, _, label in rows}
    links = [
        (a, b) for a in good for b in good
        if a < b and labels[a] == labels[b] and len(good[a]) == len(good[b])
        and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.98
    ]
    want, counts = roots(labels, links), {k: sum(k in p for p in links) for k in labels}
    for block in (2048, 7):
        embedding_dedup.links_of.__defaults__ = (embedding_dedup.COSINE, block)  # blocks smaller than a cell
        got = embedding_dedup.near_duplicates(table).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {k: (counts[k], want[k], want[k] == k) for k in labels}
    embedding_dedup.links_of.__defaults__ = (embedding_dedup.COSINE, embedding_dedup.BLOCK)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("n, m", [(1, 0), (6, 4), (40, 25), (40, 400), (300, 299)])
def test_roots_connect_as_links_do(n, m):
    r = np.random.default_rng(n * m)
    a, b = r.integers(0, n, m), r.integers(0, n, m)
    if m == n - 1:  # one long path in a mixed order
        path = r.permutation(n)
        a, b = path[:-1], path[1:]
    want = roots(range(n), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert embedding_dedup.roots_of(a, b, n).tolist() == [want[k] for k in range(n)]


def test_links_of_a_dense_group_are_not_listed(spark):
    """A group in which all are linked gives a row per vector and pair of blocks, not per pair."""
    r = np.random.default_rng(5)
    base = r.standard_normal(64)
    rows = [(k, (base + 0.01 * r.standard_normal(64)).tolist(), "one") for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    named = embedding_dedup.vectors(table)
    classes = named.select("label", "dim", F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), "first", "vector")
    found = embedding_dedup.links_of(classes, block=100).collect()
    assert sum(f.partners for f in found) == 300 * 299
    assert len(found) < 300 * 8
    got = embedding_dedup.near_duplicates(table).collect()
    assert {(g.n_links, g.component_id, g.kept) for g in got} == {(299, 0, False), (299, 0, True)}


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(150):
        text = r.integers(1, 1 + int(r.integers(1, 5)), int(r.integers(1, 90))).astype(np.uint8)
        data = text.tobytes()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        common = adjacent_common(text, order, 200)
        for k in range(1, len(order)):
            a, b = data[order[k - 1] :], data[order[k] :]
            assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def brute_repeats(rows, length):
    first = {}
    data = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data[i] = (text or "").encode()
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], i)
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if first[d[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out[i] = (int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), kept)
    return out


def passage_rows():
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcd é") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 400), (5, "ab" * 300 + "x"), (6, "é" * 200), (7, "é" * 90), (None, shared[4])]
    for k in range(40):
        rows.append((20 - k if k < 8 else 20 + k, "".join(r.choice([text(r.randint(0, 60)), r.choice(shared), r.choice(shared)]) for _ in range(6))))
    rows += [(200, rows[-1][1]), (201, rows[-1][1]), (202, text(30_000) + shared[3])]
    return [row for k, row in enumerate(rows) if row[0] not in {x[0] for x in rows[:k]}]


def test_repeated_passages(spark):
    rows = passage_rows()
    want = brute_repeats(rows, 50)
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, class string, kept int")
    got = suffix_dedup.repeats(table).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        i = row["doc_id"]
        data = (texts[i] or "").encode()
        if i is None:
            assert row["n_removed"] == 0
            continue
        kept = data if row["kept"] is None else bytes(row["kept"])
        assert (row["n_bytes"], row["n_removed"], len(row["spans"]), kept) == (len(data), *want[i])
    cut = {r["doc_id"]: r for r in suffix_dedup.without_repeats(table).collect()}
    assert {i: r["text"] for i, r in cut.items() if i is not None} == {
        i: None if texts[i] is None else k.decode("utf-8", "ignore") for i, (_, _, k) in want.items()
    }
    assert cut[4]["class"] == "x" and len(cut) == len(rows)
    assert suffix_dedup.repeats(table.limit(0)).count() == 0


@pytest.mark.parametrize("length", [50, 60])
def test_anchors_depend_on_content_only(length):
    r = np.random.default_rng(4)
    passage = r.integers(97, 110, 200).astype(np.uint8)
    found = []
    for pad in (0, 13, 90):
        data = np.concatenate([r.integers(97, 110, pad).astype(np.uint8), passage, r.integers(97, 110, 70).astype(np.uint8)])
        at = suffix_dedup.anchors_of(data, np.array([0]), np.array([len(data)]), length)
        found.append(set((at[(at >= pad + length) & (at <= pad + 200 - length)] - pad).tolist()))
    assert found[0] == found[1] == found[2] and found[0]
