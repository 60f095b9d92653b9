"""Conversation repair, Merkle manifests and nearest neighbours against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillmill.llm import ann, conversation_repair, merkle
from quillmill.llm.role_parser import RoleParser, joined

BLANK = " \t\n\x0b\x0c\r"
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """Least (cost, audit) over all edits of rows (initial, must be deleted, truncated)."""
    best = [(10**9, "")]

    def go(i, state, cost, audit, inserted):
        if cost > best[0][0]:
            return
        if i == len(rows) and state in (0, 3):
            best[0] = min(best[0], (cost, audit))
        if inserted < 3:
            for symbol in set("ua") & set(STEPS[state]):
                go(i, STEPS[state][symbol], cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            initial, must, cut = rows[i]
            go(i + 1, state, cost + 2, audit + "D", 0)
            for symbol in set("ua") & set(STEPS[state]) if not must else ():
                go(i + 1, STEPS[state][symbol], cost + 1 + 5 * cut, audit + "R", 0)
            if not must and initial in STEPS[state]:
                go(i + 1, STEPS[state][initial], cost + 5 * cut, audit + "K", 0)

    go(0, 0, 0, "", 0)
    return best[0]


def test_parser_equals_brute_force_and_stretches_compose():
    r, parser = random.Random(1), RoleParser()
    for _ in range(600):
        rows = [(r.choice(["s", "u", "a", "x", ""]), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randint(0, 6))]
        assert parser.finish(parser.parse(rows)) == cheapest(rows)
        cut = r.randint(0, len(rows))
        tail = {(start, end): v for start in parser.stacks() for end, v in parser.parse(rows[cut:], start).items()}
        assert parser.finish(joined(parser.parse(rows[:cut]), tail)) == cheapest(rows)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def repaired(conv, rows):
    mine = [r for r in damaged(rows) if r[0] == conv]
    mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen, counts = [], set(), [0, 0, 0]
    for _, _, role, text in mine:
        body = text.rstrip(BLANK)
        kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        faults.append((role[:1], kind in (0, 1), kind == 2))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:], strict=False))
    cost, audit = cheapest(faults)
    lines, at, due = [], 0, "user"
    for edit in audit:
        role, text = ("", "") if edit == "I" else mine[at][2:]
        at += edit != "I"
        if edit == "D":
            continue
        role = role if edit == "K" else due
        lines.append(f"{role}:{text}")
        due = "assistant" if role[:1] == "u" else "user"
    turns = [r[1] for r in mine if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(n=60, seed=3):
    r = random.Random(seed)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (7, None, "user", "No turn."), (7, None, "user", "No turn."), (-1, 5, "", "x"), (-1, 5, "tool", "é?")]
    for conv in range(100, 100 + n):
        for turn in range(r.randint(1, 6)):
            if r.random() < 0.9:
                rows.append((conv, turn, r.choice(["system", "user", "assistant", "assistant", "user"]), r.choice(["Yes.", "no", "Why?", " \n", f"t{turn}!", "x\x0b."])))
    return rows


@pytest.mark.parametrize("partitions", ["3", "60"])
def test_repair_equals_brute_force(spark, partitions):
    rows = conversations()
    df = spark.createDataFrame([(*row, "mine", 1) for row in rows], "conv_id long, turn long, role string, text string, audit string, n int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {tuple(r) for r in conversation_repair.repair(conversation_repair.damaged(df)).collect()}
        assert got == {repaired(conv, rows) for conv in {r[0] for r in rows}}
        assert conversation_repair.repair(conversation_repair.damaged(df.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_long_conversation_over_many_ranges(spark):
    df = spark.range(3000).selectExpr(
        "5L as conv_id", "id as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", "case when id % 50 = 7 then 'again.' else concat('t', id, '.') end as text"
    )
    (got,) = conversation_repair.repair(conversation_repair.damaged(df)).collect()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    mine, parser, seen, faults = damaged(rows), RoleParser(), set(), []
    for _, _, role, text in mine:
        blank = not text.strip(BLANK)
        again = not blank and (role, text) in seen
        seen.add((role, text))
        faults.append((role[0], blank or again, not blank and not again and text[-1] != "."))
    assert (got["cost"], got["audit"]) == parser.finish(parser.parse(faults))
    assert got["duplicate"] > 59 and len(got["audit"]) >= len(mine)


def tree(digests):
    """Levels of digests as hex, by definition."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + 3]).encode()).hexdigest() for i in range(0, len(last), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        low = i // 3 * 3
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        i //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_appender(n):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    levels = tree([d.hex() for d in digests])
    appender = merkle.Appender()
    for d in digests:
        appender.append(d)
    assert appender.root().hex() == levels[-1][0]
    for i, path in enumerate(appender.paths):
        assert [(a.hex(), b.hex()) for a, b in path] == siblings(levels, i)


@pytest.mark.parametrize("block_levels", [7, 1])
def test_manifest(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**block_levels)
    rows = [(k, f"t\n{k}" if k % 5 else None, "en" if k % 3 else None, ["a", "é", "b", None][k % 17 % 4], k if k % 2 else None) for k in range(80)]
    rows += [(None, "no\nid", "en", "a", 1), (5, "t\n5", "en", "a", 5), (5, "t\n5", "en", "a", 5), (900, "", "en", "alone", 0)]
    df = spark.createDataFrame([(*r, "mine", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int")
    hashed = lambda r, text: hashlib.sha256("".join(
        "-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)).encode()).hexdigest()
    by_source = {}
    for r in rows:
        chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        by_source.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, hashed(r, r[1]), hashed(r, r[1].replace("\n", "") if chosen else r[1])))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for *_, leaf, _ in sorted(by_source[s])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    want = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, leaf, tampered) in enumerate(sorted(by_source[s])):
            path = siblings(trees[s], i) + siblings(top, k)
            node = tampered
            for before, after in path:
                node = hashlib.sha256((before + node + after).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest()
            want.append((str(doc_id if known else None), leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    got = merkle.verified(merkle.manifest(df)).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(want)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)
    assert merkle.verified(merkle.manifest(df.limit(0))).count() == 0


def nearest_by_definition(rows, queries, k):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q, w in sorted(sound):
        if q in queries:
            a = np.array(w, float)
            near = []
            for i, v in sound:
                if i != q and len(v) == len(w):
                    b = np.array(v, float)
                    near.append((-round(float((a / np.linalg.norm(a)) @ (b / np.linalg.norm(b))), 9), i))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k])]
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours(spark, block):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + (0.05 if i % 2 else 1.0) * r.standard_normal(16)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(30)]  # copies: ties go to smaller ids
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (None, rows[0][1]), (600, [1.0, 2.0]), (550, [3.0, 2.0]), rows[3]]
    df = spark.createDataFrame([(*row, 9, "x") for row in rows], "vec_id long, embedding array<double>, rank int, side string")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 5, block=block, query_block=4).collect()
    want = nearest_by_definition(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    mine = sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in got)
    assert len(mine) == len(want)
    assert len(set(mine) & set(want)) >= 0.98 * len(want)
    copies = [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 50]
    assert copies == [400, 401, 402, 403, 404]
    assert [(x["vec_id"], x["rank"]) for x in got if x["query_id"] == 600] == [(550, 1)]  # all there are
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_least_collisions_keep_what_is_within_the_radius():
    fewest = ann.least_collisions()
    r = np.random.default_rng(1)
    hits = (np.abs(r.standard_normal((200_000, ann.DIRECTIONS))) <= ann.WINDOW).sum(1)
    assert (hits < fewest).mean() < 3 * ann.MISS
