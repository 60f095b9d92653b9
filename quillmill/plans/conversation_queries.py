"""Queries over conversations and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ASSISTANT_END, PYTHON_END, PYTHON_START
from ..functions.calculator import calculate
from ..functions.codec import bpe_encode
from ..functions.vocabulary import BYTE_TO_ID
from ..operators import conversations as conv
from ..operators import toolcalls
from . import fixtures, sql
from .registry import joined, query


def messages(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("int"))


def disturbed(spark, sf_dir):
    """Conversations of which some are broken on purpose."""
    c, t = F.col("conv_id") % 7, F.col("turn")
    role = F.when((c == 3) & (t == 2), "assistant").when((c == 5) & (t == 0), "system").otherwise(F.col("role"))
    return messages(spark, sf_dir).withColumn("role", role)


CHECKED = """
m AS (
  SELECT conv_id, turn, text, CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN 'assistant'
         WHEN conv_id % 7 = 5 AND turn = 0 THEN 'system' ELSE role END AS role
  FROM conversations
),
heads AS (
  SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) = 'system' AS sys,
         coalesce(max(CASE WHEN turn = 1 THEN role END), '') = 'user' AS user_second FROM m GROUP BY conv_id
),
placed AS (SELECT m.*, sys, user_second, turn - (CASE WHEN sys THEN 1 ELSE 0 END) AS k FROM m JOIN heads USING (conv_id)),
wrong AS (
  SELECT conv_id, any_value(sys) AND NOT any_value(user_second) AS lone,
         bool_or(k >= 0 AND role <> CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END) AS bad
  FROM placed GROUP BY conv_id
)"""


@query(f"""
WITH {CHECKED}
SELECT m.conv_id, count(*) AS n_messages,
       CASE WHEN any_value(lone) THEN 'system_without_user' WHEN any_value(bad) THEN 'role_order' END AS reason
FROM m JOIN wrong w ON w.conv_id = m.conv_id GROUP BY m.conv_id
""", name="validate_conversations")
def validate_query(spark, sf_dir):
    rows = disturbed(spark, sf_dir)
    _, rejects = conv.validate_conversations(rows)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages")).join(rejects, "conv_id", "left")


@query("""
SELECT conv_id, last(role ORDER BY turn) AS last_role, last(role ORDER BY turn) = 'assistant' AS ok
FROM conversations GROUP BY conv_id
""", name="validate_completion_prompt")
def completion_check_query(spark, sf_dir):
    return conv.validate_completion_prompt(messages(spark, sf_dir))


MERGED = """
sys AS (SELECT conv_id, text AS system_text FROM conversations WHERE turn = 0 AND role = 'system'),
merged AS (
  SELECT c.conv_id, c.turn - (CASE WHEN s.conv_id IS NULL THEN 0 ELSE 1 END) AS turn, c.role,
         CASE WHEN s.conv_id IS NOT NULL AND c.turn = 1 THEN s.system_text || chr(10) || chr(10) || c.text ELSE c.text END AS text
  FROM conversations c LEFT JOIN sys s ON s.conv_id = c.conv_id WHERE s.conv_id IS NULL OR c.turn > 0
)"""


@query(f"WITH {MERGED}\nSELECT conv_id, turn, role, md5(text) AS digest FROM merged", name="merge_system")
def merge_query(spark, sf_dir):
    return conv.merge_system(messages(spark, sf_dir)).select(
        "conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("digest")
    )


RENDERED = MERGED + f""",
bad AS (SELECT conv_id FROM merged GROUP BY conv_id
        HAVING bool_or(role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END)),
segs AS (
  SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last_turn,
    CASE role WHEN 'user' THEN [1] || b || [2] ELSE [3] || b || [4] END AS ids,
    CASE role WHEN 'user' THEN list_transform([1] || b || [2], lambda x: 0)
         ELSE [0] || list_transform(b || [4], lambda x: 1) END AS mask
  FROM (SELECT *, {sql.byte_ids("text")} AS b FROM merged WHERE conv_id NOT IN (SELECT conv_id FROM bad))
)"""


@query(f"""
WITH {RENDERED},
whole AS (SELECT conv_id, [0] || flatten(list(ids ORDER BY turn)) AS ids, [0] || flatten(list(mask ORDER BY turn)) AS mask
          FROM segs GROUP BY conv_id)
SELECT conv_id, array_to_string(ids[1:2048], ',') AS ids, array_to_string(mask[1:2048], ',') AS mask, len(ids) > 2048 AS truncated
FROM whole
""", name="render_conversation")
def render_query(spark, sf_dir):
    return conv.render_conversation(messages(spark, sf_dir)).select(
        "conv_id", joined(F.col("ids")).alias("ids"), joined(F.col("mask")).alias("mask"), "truncated"
    )


@query(f"""
WITH {RENDERED},
lasts AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING last(role ORDER BY turn) = 'assistant')
SELECT conv_id, array_to_string(([0] || flatten(list(ids ORDER BY turn)))[1:2048] || [3], ',') AS ids
FROM segs WHERE turn < last_turn AND conv_id IN (SELECT conv_id FROM lasts) GROUP BY conv_id
""", name="render_for_completion")
def completion_query(spark, sf_dir):
    return conv.render_for_completion(messages(spark, sf_dir)).select("conv_id", joined(F.col("ids")).alias("ids"))


NEWLINE, STOP, COMMA = BYTE_TO_ID[10], BYTE_TO_ID[46], BYTE_TO_ID[44]


def marked_documents(spark, sf_dir):
    """Documents as generated token rows: a newline opens a tool call and a full stop
    closes it; a comma ends the answer."""
    def swap(x):
        return (
            F.when(x == NEWLINE, PYTHON_START).when(x == STOP, PYTHON_END).when(x == COMMA, ASSISTANT_END).otherwise(x)
        )

    docs = fixtures.corpus(spark, sf_dir).withColumn("ids", bpe_encode(F.col("text")))
    return docs.select(F.col("row").alias("seq_id"), F.transform("ids", swap).alias("ids"))


MARKED = f"""
marked AS (
  SELECT doc_id AS seq_id, list_transform({sql.byte_ids("text")},
    lambda x: CASE x WHEN {NEWLINE} THEN 5 WHEN {STOP} THEN 6 WHEN {COMMA} THEN 4 ELSE x END) AS ids
  FROM documents
)"""


@query(f"""
WITH {MARKED},
long AS (SELECT seq_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS p FROM marked),
marks AS (
  SELECT seq_id, id, p, lag(id) OVER w AS before_id, lag(p) OVER w AS before_p
  FROM long WHERE id IN (5, 6) WINDOW w AS (PARTITION BY seq_id ORDER BY p)
)
SELECT k.seq_id, before_p AS start_pos, p AS end_pos, array_to_string(m.ids[before_p + 2:p], ',') AS expr_ids
FROM marks k JOIN marked m USING (seq_id) WHERE id = 6 AND before_id = 5 AND p - before_p > 1
""", name="tool_call_spans")
def spans_query(spark, sf_dir):
    return toolcalls.tool_call_spans(marked_documents(spark, sf_dir)).withColumn(
        "expr_ids", joined(F.col("expr_ids"))
    )


@query(f"""
WITH {MARKED},
ends AS (
  SELECT seq_id, ids, list_position(list_transform(ids, lambda x, i: x IN (0, 4) AND i > 100), true) AS p FROM marked
)
SELECT seq_id, CASE WHEN p IS NULL OR p = 0 THEN len(ids) ELSE p - 1 END AS n_kept,
       md5(array_to_string(ids[1:CASE WHEN p IS NULL OR p = 0 THEN len(ids) ELSE p - 1 END], ',')) AS digest,
       greatest(CASE WHEN p IS NULL OR p = 0 THEN len(ids) ELSE p - 1 END - 100, 0) AS n_sampled
FROM ends
""", name="cut_at_terminal")
def cut_query(spark, sf_dir):
    rows = marked_documents(spark, sf_dir).withColumns({
        "mask": F.transform("ids", lambda x: F.lit(1)), "prompt_len": F.lit(100),
    })
    return toolcalls.cut_at_terminal(rows).select(
        "seq_id", F.size("ids").alias("n_kept"), F.md5(joined(F.col("ids"))).alias("digest"),
        F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_sampled"),
    )


def expressions(spark, sf_dir):
    """Calculator input from order keys, prices and names; some of it not permitted."""
    orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c = F.format_number("k", 0), F.col("c").cast("string")
    letters = F.lower(F.md5(c))
    expr = (
        F.when(F.col("k") % 4 == 0, F.concat(k, F.lit("+"), c, F.lit("*2")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("("), k, F.lit(" - "), c, F.lit(")")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("'"), letters, F.lit("'.count('a')")))
        .otherwise(F.concat(k, F.lit("**2")))
    )
    return orders.select(F.col("k").alias("seq_id"), expr.alias("expr"))


RESULTS = """
results AS (
  SELECT o_orderkey AS seq_id, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey + o_custkey * 2)::VARCHAR
    WHEN 1 THEN (o_orderkey - o_custkey)::VARCHAR
    WHEN 2 THEN (32 - length(replace(md5(o_custkey::VARCHAR), 'a', '')))::VARCHAR END AS result
  FROM orders
)"""


@query(f"WITH {RESULTS}\nSELECT seq_id, result FROM results", name="audit_tool_calls")
def audit_query(spark, sf_dir):
    return expressions(spark, sf_dir).select("seq_id", calculate(F.col("expr")).alias("result"))


@query(f"""
WITH {RESULTS}
SELECT seq_id, '7,' || array_to_string({sql.byte_ids("result")}, ',') || ',8' AS result_ids FROM results WHERE result IS NOT NULL
""", name="tool_result_tokens")
def result_query(spark, sf_dir):
    calls = expressions(spark, sf_dir).select(
        "seq_id", F.concat(F.array(F.lit(PYTHON_START)), bpe_encode(F.col("expr")), F.array(F.lit(PYTHON_END))).alias("ids")
    )
    audited = toolcalls.audit_tool_calls(toolcalls.tool_call_spans(calls))
    return toolcalls.tool_result_tokens(audited).select("seq_id", joined(F.col("result_ids")).alias("result_ids"))
