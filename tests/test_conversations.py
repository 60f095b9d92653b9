import time
import warnings

import pytest
from pyspark.sql import functions as F

from quillmill.functions.calculator import calculate, evaluate
from quillmill.functions.codec import bpe_encode
from quillmill.functions.vocabulary import BYTE_TO_ID
from quillmill.operators import conversations as conv
from quillmill.operators.toolcalls import audit_tool_calls, cut_at_terminal, tool_call_spans, tool_result_tokens

SCHEMA = f"conv_id bigint, turn int, role string, text string, parts {conv.PARTS_TYPE}"


def ids(text):
    return [BYTE_TO_ID[b] for b in text.encode()]


def talk(spark, *messages):
    rows = [(m[0], m[1], m[2], m[3] if isinstance(m[3], str) or m[3] is None else None,
             m[3] if isinstance(m[3], list) else None) for m in messages]
    return spark.createDataFrame(rows, SCHEMA)


def test_rejects(spark):
    df = talk(
        spark,
        (1, 0, "user", "a"), (1, 1, "assistant", "b"),
        (2, 0, "system", "s"),
        (3, 0, "system", "s"), (3, 1, "assistant", "b"),
        (4, 0, "user", "a"), (4, 1, "user", "b"),
        (5, 0, "user", "a"), (5, 1, "assistant", [("image", "x")]),
        (6, 0, "user", [("text", "x")]),
        (7, 0, "user", None),
        (8, 0, "user", "a"), (8, 1, "assistant", None),
        (9, 0, "system", "s"), (9, 1, "user", "a"), (9, 2, "assistant", [("text", "t"), (None, None)]),
        (10, 0, "user", "a"), (10, 1, "tool", "b"),
        (11, 0, "assistant", "a"),
    )
    good, bad = conv.validate_conversations(df)
    assert {r.conv_id: r.reason for r in bad.collect()} == {
        2: "system_without_user", 3: "system_without_user", 4: "role_order", 5: "part_type", 6: "user_content",
        7: "user_content", 8: "assistant_content", 10: "role_order", 11: "role_order",
    }
    assert {(r.conv_id, r.turn, r.text) for r in good.filter("conv_id = 9").collect()} == {(9, 0, "s\n\na"), (9, 1, None)}


def test_render_parts_and_mask(spark):
    df = talk(spark, (1, 0, "system", "S"), (1, 1, "user", "hi"),
              (1, 2, "assistant", [("text", "ok"), ("python", "1+1"), ("python_output", "2"), ("text", "!")]))
    row = conv.render_conversation(df).first()
    want = [(0, 0), (1, 0)] + [(i, 0) for i in ids("S\n\nhi")] + [(2, 0), (3, 0)]
    want += [(i, 1) for i in ids("ok")] + [(5, 1)] + [(i, 1) for i in ids("1+1")] + [(6, 1), (7, 0)]
    want += [(i, 0) for i in ids("2")] + [(8, 0)] + [(i, 1) for i in ids("!")] + [(4, 1)]
    assert list(zip(row.ids, row["mask"])) == want and not row.truncated


def test_truncation(spark):
    df = talk(spark, (1, 0, "user", "abc"), (1, 1, "assistant", "de"), (1, 2, "user", "f"))
    whole = conv.render_conversation(df, max_tokens=None).first()
    assert len(whole.ids) == 1 + 5 + 4 + 3
    for cap in (1, 2, 6, 12, 13, 14):
        row = conv.render_conversation(df, max_tokens=cap).first()
        assert row.ids == whole.ids[:cap] and row["mask"] == whole["mask"][:cap] and row.truncated == (cap < 13)


def test_completion(spark):
    df = talk(spark, (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"),
              (2, 0, "user", "a"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "r"))
    got = {r.conv_id: r.ids for r in conv.render_for_completion(df).collect()}
    assert got == {1: [0, 1, *ids("a"), 2, 3, *ids("b"), 4, 1, *ids("c"), 2, 3], 3: [0, 1, *ids("s\n\nq"), 2, 3]}
    assert conv.render_for_completion(df, max_tokens=4).filter("conv_id = 1").first().ids == [0, 1, ids("a")[0], 2, 3]
    assert {r.conv_id: r.ok for r in conv.validate_completion_prompt(df).collect()} == {1: True, 2: False, 3: True}


def test_number_turns(spark):
    df = spark.createDataFrame([(1, 10, "user", "a"), (1, 30, "assistant", "b"), (2, 5, "user", "c")],
                               "conv_id bigint, turn bigint, role string, text string")
    assert {(r.conv_id, r.text): r.turn for r in conv.number_turns(df).collect()} == {(1, "a"): 0, (1, "b"): 1, (2, "c"): 0}


def test_tool_spans(spark):
    rows = [(1, [5, 70, 6]), (2, [5, 6]), (3, [5, 70, 5, 71, 72, 6]), (4, [70, 6, 6]), (5, [5, 70, 6, 71, 6, 5, 72, 6]),
            (6, []), (7, [5, 70])]
    spans = tool_call_spans(spark.createDataFrame(rows, "seq_id int, ids array<int>"))
    assert sorted((r.seq_id, r.start_pos, r.end_pos, r.expr_ids) for r in spans.collect()) == [
        (1, 0, 2, [70]), (3, 2, 5, [71, 72]), (5, 0, 2, [70]), (5, 5, 7, [72])]


def test_cut(spark):
    rows = [(1, [0, 50, 51, 4, 52], [1] * 5, 2), (2, [0, 50, 51], [1] * 3, 1), (3, [0, 50, 0, 51], [1] * 4, 2),
            (4, [0, 4, 9, 9], [1, 1, 0, 1], 2)]
    out = cut_at_terminal(spark.createDataFrame(rows, "k int, ids array<int>, mask array<int>, prompt_len int"))
    assert {r.k: (r.ids, r["mask"]) for r in out.collect()} == {
        1: ([0, 50, 51], [0, 0, 1]), 2: ([0, 50, 51], [0, 1, 1]), 3: ([0, 50], [0, 0]), 4: ([0, 4, 9, 9], [0, 0, 0, 1])}


@pytest.mark.parametrize("expr, want", [
    ("1,000+2", "1002"), ("2**9", None), ("'strawberry'.count('r')", "3"), ("__import__('os')", None), ("1/0", None),
    ("7/2", "3.5"), ("7//2", "3"), ("-(2 - 5)", "3"), (" 1+1", "2"), ("1 +", None), ("", None), ("'a'.upper()", None),
    ("\"Aa\".lower().count('a')", "2"), ("eval('1').count('1')", None), ("'x'.count('y').real", "0"), ("007", None),
    ("1(2)", None), ("'a' * 3", None), ("x.count('a')", None), (None, None),
])
def test_calculator(spark, expr, want):
    assert spark.createDataFrame([(expr,)], "e string").select(calculate(F.col("e"))).first()[0] == want


FORMS = [
    "()", "...", "1.5*4", "1 - - 2", "7//0", "9" * 40 + "*" + "9" * 40, "+".join(["1"] * 900), "- + -3", "1..", "(1.5).5", "*()",
    "'a b a'.split().count('a')", "'a' 'b'.count('b')", "b'aab'.count(b'a')", "r'ab'.count('b')", "f'ab'.count('b')",
    "'banana'.upper().count('A')", "'abc'.count('b') and 'yes'", "'abc'.count('z') or 'no'", "not 'abc'.count('z')",
    "'a' in 'abc' and 'abc'.count('a') in (1).to_bytes()", "'x' not in 'abc'.count('a').hex()", "'abc'.count('a') is 1",
    "'one' if 'abc'.count('a') else 'none'", "None if 'a'.count('a') else 1", "'abc'.count('a') and None",
    "'a'.join(c for c in 'xyz').count('a')", "'a'.join(c for c in 'xyz' if c not in 'y' for d in 'pq').count('a')",
    "''.join(c.upper() for c in 'abc' if 'abab'.count(c))", "'a'.join('bcd').count('a')", "'7'.zfill(12).count('0')",
    "'a'.center(9).count(' ')", "'abc'.partition('b').count('b')", "().count(1)", "(5).bit_length() if 'a'.count('a') else 0",
    "'a'.count('a').numerator", "'a'.count('a').missing", "'a'.count()", "'a'.count(1)", "name.count('a')", "'a'.index('z').count('a')",
    "'aXb'.swapcase().find('x') if 'a'.count('a') else 0", "'a'.count('a').real.imag", "1.5.hex().count('8')", "0x1F if 'a'.count('a') else 0",
    "'abc'.encode().count(b'a')", "'a b'.title().count('A')", "(x for x in 'abc').count('a')", "'a'.join(1 for c in 'ab').count('1')",
    "lambda.count('a')", "'a'.count('a'", "'abc'.isalpha() and 'abc'.count('c')", "True if 'b'.count('a') else False", "1j if 'a'.count('a') else 0",
]


def test_calculator_equals_the_language(spark):
    """Every form that the character rules leave has the value that the language gives it."""

    def want(expr):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                found = eval(expr, {"__builtins__": {}}, {})  # noqa: S307 - the fixed list above
            return None if found is None else str(found)
        except Exception:
            return None

    rows = spark.createDataFrame([(e,) for e in FORMS], "e string").select("e", calculate(F.col("e")).alias("r")).collect()
    assert {r.e: r.r for r in rows} == {e: want(e) for e in FORMS}


LOOPS = " ".join(f"for {v} in 'abcdefghij'" for v in "abcdefghijkl")  # a million million turns


@pytest.mark.parametrize("expr", [
    f"''.join('' {LOOPS}).count('a')", f"'a' in ('b' {LOOPS}) and 'a'.count('a')", "'a'.center(99999999999).count(' ')",
    "(5).to_bytes(9999999999).count(b'a')", "'b'.ljust(900000).join('c'.ljust(900000)).count('b')", "'a'.count", "('a'.count(c) for c in 'ab')",
    "b''.fromhex('7b307d').decode().format('a'.count('a'))", "'a b'.split().append('a').count('a')", "'a'.encode('idna').count(b'a')",
    "x.count('a') if 'a'.count('a') else 1", "(" * 500 + "1" + ")" * 500,
])
def test_calculator_ends(spark, expr):
    began = time.monotonic()
    assert spark.createDataFrame([(expr,)], "e string").select(calculate(F.col("e"))).first()[0] is None
    assert time.monotonic() - began < 30


def test_calculator_budget_is_a_parameter():
    assert [evaluate("'ab'.join('xyz').count('a')", steps) for steps in (3, 100)] == [None, "2"]
    assert [evaluate("'a'.zfill(50).count('0')", 100, size) for size in (49, 50)] == [None, "49"]


def test_tool_results(spark):
    text = spark.createDataFrame([(1, "2*21"), (2, "oops")], "seq_id int, t string")
    calls = text.select("seq_id", F.concat(F.array(F.lit(5)), bpe_encode(F.col("t")), F.array(F.lit(6))).alias("ids"))
    rows = tool_result_tokens(audit_tool_calls(tool_call_spans(calls))).collect()
    assert [(r.seq_id, r.result, r.result_ids, r.result_mask) for r in rows] == [(1, "42", [7, *ids("42"), 8], [0] * 4)]
