"""Tool calls inside generated token sequences.

Sequences are rows with an ``ids`` array; all work stays in the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ASSISTANT_END, BOS, OUTPUT_END, OUTPUT_START, PYTHON_END, PYTHON_START
from ..functions.calculator import calculate
from ..functions.codec import bpe_decode, bpe_encode
from ..functions.vocabulary import BYTE_LEVEL, Vocabulary


def tool_call_spans(df: DataFrame, key: str = "seq_id", ids: str = "ids") -> DataFrame:
    """One row per closed, non-empty tool call: ``(key, start_pos, end_pos, expr_ids)``
    with the positions of its markers. A call is an end marker whose nearest earlier
    marker is a start marker, so a second start restarts it."""
    marks = F.filter(
        F.transform(ids, lambda x, i: F.struct(x.alias("id"), i.alias("at"))),
        lambda m: m["id"].isin(PYTHON_START, PYTHON_END),
    )
    neighbours = F.zip_with(
        "_m", F.slice("_m", F.lit(2), F.greatest(F.size("_m"), F.lit(1))),
        lambda a, b: F.struct(
            ((a["id"] == PYTHON_START) & (b["id"] == PYTHON_END)).alias("call"),
            a["at"].alias("start_pos"), b["at"].alias("end_pos"),
        ),
    )
    calls = F.filter(neighbours, lambda c: c["call"] & (c["end_pos"] - c["start_pos"] > 1))
    return (
        df.withColumn("_m", marks)
        .select(key, F.col(ids).alias("_ids"), F.explode(calls).alias("c"))
        .select(
            key, F.col("c.start_pos").alias("start_pos"), F.col("c.end_pos").alias("end_pos"),
            F.slice("_ids", F.col("c.start_pos") + 2, F.col("c.end_pos") - F.col("c.start_pos") - 1).alias("expr_ids"),
        )
    )


def audit_tool_calls(spans: DataFrame, vocab: Vocabulary = BYTE_LEVEL) -> DataFrame:
    """Add the call's text ``expr`` and its ``result`` (null when refused or failed)."""
    return spans.withColumn("expr", bpe_decode(F.col("expr_ids"), vocab)).withColumn(
        "result", calculate(F.col("expr"))
    )


def tool_result_tokens(audited: DataFrame, vocab: Vocabulary = BYTE_LEVEL) -> DataFrame:
    """Add the tokens to insert after each call, all with mask 0; calls without a
    result insert nothing and are left out."""
    wrapped = bpe_encode(F.col("result"), vocab, prepend=OUTPUT_START, append=OUTPUT_END)
    return (
        audited.filter(F.col("result").isNotNull())
        .withColumn("result_ids", wrapped)
        .withColumn("result_mask", F.array_repeat(F.lit(0), F.size("result_ids")))
    )


def cut_at_terminal(df: DataFrame, ids: str = "ids", mask: str = "mask", prompt_len: str = "prompt_len") -> DataFrame:
    """Drop the first terminal token after the prompt and all that follows, in ids
    and mask alike. The prompt's mask becomes 0."""
    prompt = F.col(prompt_len)
    terminal = F.filter(
        F.transform(ids, lambda x, i: F.when(x.isin(ASSISTANT_END, BOS) & (i >= prompt), i)),
        lambda i: i.isNotNull(),
    )
    keep = F.coalesce(F.get(terminal, F.lit(0)), F.size(ids))
    masked = F.transform(mask, lambda m, i: F.when(i < prompt, 0).otherwise(m))
    return df.withColumn("_keep", keep).withColumns({
        ids: F.slice(ids, F.lit(1), F.col("_keep")),
        mask: F.slice(masked, F.lit(1), F.col("_keep")),
    }).drop("_keep")
