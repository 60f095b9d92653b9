"""Rows with equal ids and different texts are documents of their own."""

import random

import pytest

from quillmill.llm import stages as corpus_pipeline
from quillmill.llm import minhash_dedup


def texts():
    r = random.Random(5)
    one, two, three = (" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    return one, two, three


@pytest.mark.parametrize("turned", [False, True])
def test_equal_ids(spark, turned):
    one, two, three = texts()
    near = one + " end"
    rows = [
        (1, one, "a"), (1, two, "b"),  # one id, two texts
        (2, near, "c"), (3, two + " end", "d"),  # copies of either
        (4, three, "e"), (4, three, "f"), (4, three.upper(), "g"),  # one class
        (4, "", "h"), (4, None, "i"), (4, "", "j"),
        (5, one + " tail", "k"), (5, three + " x y z", "l"),  # near copies of smaller ids, which stay
        (None, one, "m"),
    ]
    table = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string, tag string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash_dedup.near_duplicates(table).collect())
    assert got == sorted([
        (1, 76, 1, True), (1, 76, 1, True), (2, 77, 1, False), (3, 77, 1, False),
        *[(4, 76, 4, True)] * 3, *[(4, 0, 4, True)] * 3, (5, 77, 1, False), (5, 79, 4, False), (0, 76, 0, True),
    ])
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()]
    assert len(kept) == 6
    assert {k for k in kept if k[1] not in (three, three.upper())} == {(1, one), (1, two), (4, ""), (4, None), (None, one)}
    assert sum(t in (three, three.upper()) for _, t in kept) == 1
