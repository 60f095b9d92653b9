"""Validating conversations and rendering them to token ids with a supervision mask.

Messages are flat rows ``(conv_id, turn, role, text)``, ``turn`` counting from 0
without gaps (``number_turns`` makes it so). An optional ``parts`` column,
``array<struct<type, text>>``, replaces the text of structured assistant messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ASSISTANT_END,
    ASSISTANT_START,
    BOS,
    MAX_RENDERED_TOKENS,
    OUTPUT_END,
    OUTPUT_START,
    PYTHON_END,
    PYTHON_START,
    USER_END,
    USER_START,
)
from ..functions.codec import bpe_encode_each
from ..functions.vocabulary import BYTE_LEVEL, Vocabulary
from .prefix import dense_index

PARTS_TYPE = "array<struct<type:string,text:string>>"
PART_TYPES = ("text", "python", "python_output")


def number_turns(messages: DataFrame) -> DataFrame:
    """Renumber the turns of every conversation from 0 without gaps."""
    return dense_index(messages, "_turn", by=["conv_id"], row="turn").drop("turn").withColumnRenamed("_turn", "turn")


def _with_parts(messages: DataFrame) -> DataFrame:
    if "parts" in messages.columns:
        return messages
    return messages.withColumn("parts", F.lit(None).cast(PARTS_TYPE))


def _violation(offset: int) -> Column:
    """What is wrong with a message if ``offset`` leading rows are merged away."""
    turn, role, parts = F.col("turn") - offset, F.col("role"), F.col("parts")
    expected = F.when(turn % 2 == 0, "user").otherwise("assistant")
    strange = F.exists(parts, lambda p: ~F.coalesce(p["type"], F.lit("text")).isin(*PART_TYPES))
    return (
        F.when(turn < 0, None)
        .when(role.isNull() | (role != expected), "role_order")
        .when((role == "user") & (parts.isNotNull() | F.col("text").isNull()), "user_content")
        .when(parts.isNull() & F.col("text").isNull(), "assistant_content")
        .when(strange, "part_type")
    )


def conversation_profile(messages: DataFrame) -> DataFrame:
    """One row per conversation: its leading system text, last turn and the reason
    to reject it, if any. A plain aggregate: both readings of the turn numbers
    (with and without a system message) are checked in the same pass."""
    checked = _with_parts(messages).withColumns({"_v0": _violation(0), "_v1": _violation(1)})
    is_system = (F.col("turn") == 0) & (F.col("role") == "system")
    first_bad = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), F.col("turn")))
    facts = checked.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"),
        F.max_by("role", "turn").alias("last_role"),
        F.bool_or(is_system).alias("has_system"),
        F.max(F.when(is_system, F.coalesce("text", F.lit("")))).alias("system_text"),
        F.bool_or((F.col("turn") == 1) & (F.col("role") == "user")).alias("_user_second"),
        first_bad("_v0").alias("_bad0"),
        first_bad("_v1").alias("_bad1"),
    )
    reason = F.when(F.col("has_system"), F.when(~F.col("_user_second"), "system_without_user").otherwise(F.col("_bad1")))
    return facts.withColumn("reason", reason.otherwise(F.col("_bad0"))).drop("_user_second", "_bad0", "_bad1")


def _merged(messages: DataFrame, profile: DataFrame) -> DataFrame:
    """Put the system text before the first user message and renumber."""
    joined = _with_parts(messages).join(profile, "conv_id")
    system = F.col("has_system")
    with_system = F.concat("system_text", F.lit("\n\n"), "text")
    return joined.filter(~(system & (F.col("turn") == 0))).withColumns({
        "text": F.when(system & (F.col("turn") == 1), with_system).otherwise(F.col("text")),
        "turn": F.col("turn") - system.cast("int"),
        "last_turn": F.col("last_turn") - system.cast("int"),
    })


def merge_system(messages: DataFrame) -> DataFrame:
    """Messages with a leading system message merged into the user message after it."""
    return _merged(messages, conversation_profile(messages)).select(*messages.columns)


def validate_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged messages of good conversations, and ``(conv_id, reason)`` of the others."""
    profile = conversation_profile(messages)
    good = _merged(messages, profile.filter(F.col("reason").isNull()))
    return good, profile.filter(F.col("reason").isNotNull()).select("conv_id", "reason")


def validate_completion_prompt(messages: DataFrame) -> DataFrame:
    """Whether each conversation ends with an assistant message."""
    return messages.groupBy("conv_id").agg(
        F.max_by("role", "turn").alias("last_role"),
        (F.max_by("role", "turn") == "assistant").alias("ok"),
    )


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _flag(ids: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value), F.size(ids))


def _segments(merged: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Token ids and mask of each message, its markers included; still one row each."""
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    parts = F.transform(
        F.coalesce("parts", plain),
        lambda p: F.struct(
            F.coalesce(p["type"], F.lit("text")).alias("type"), F.coalesce(p["text"], F.lit("")).alias("text")
        ),
    )
    encoded = merged.withColumn("_p", parts).withColumn(
        "_e", bpe_encode_each(F.transform("_p", lambda p: p["text"]), vocab)
    )

    def body(p: Column, ids: Column) -> Column:
        return (
            F.when(p["type"] == "python", F.concat(_ids(PYTHON_START), ids, _ids(PYTHON_END)))
            .when(p["type"] == "python_output", F.concat(_ids(OUTPUT_START), ids, _ids(OUTPUT_END)))
            .otherwise(ids)
        )

    def body_mask(p: Column, ids: Column) -> Column:
        whole = body(p, ids)
        return F.when(p["type"] == "python_output", _flag(whole, 0)).otherwise(_flag(whole, 1))

    is_user = F.col("role") == "user"
    bodies = F.flatten(F.zip_with("_p", "_e", body))
    masks = F.flatten(F.zip_with("_p", "_e", body_mask))
    return encoded.select(
        *merged.columns,
        F.when(is_user, F.concat(_ids(USER_START), bodies, _ids(USER_END)))
        .otherwise(F.concat(_ids(ASSISTANT_START), bodies, _ids(ASSISTANT_END))).alias("seg"),
        F.when(is_user, F.concat(_ids(0), _flag(bodies, 0), _ids(0)))
        .otherwise(F.concat(_ids(0), masks, _ids(1))).alias("seg_mask"),
    )


def _render(merged: DataFrame, vocab: Vocabulary, max_tokens: int | None) -> DataFrame:
    if max_tokens is not None:
        # A message has at least two tokens, so later turns cannot be reached. With
        # this a group holds at most max_tokens/2 messages of max_tokens tokens.
        merged = merged.filter(F.col("turn") <= max_tokens // 2)
    segments = _segments(merged, vocab)
    cut = (lambda c: F.slice(c, 1, max_tokens)) if max_tokens is not None else (lambda c: F.col(c))
    grouped = segments.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", cut("seg").alias("i"), cut("seg_mask").alias("m")))).alias("s"),
        F.sum(F.size("seg").cast("bigint")).alias("n"),
    )
    ids = F.concat(_ids(BOS), F.flatten(F.transform("s", lambda x: x["i"])))
    mask = F.concat(_ids(0), F.flatten(F.transform("s", lambda x: x["m"])))
    if max_tokens is None:
        return grouped.select("conv_id", ids.alias("ids"), mask.alias("mask"), F.lit(False).alias("truncated"))
    return grouped.select(
        "conv_id",
        F.slice(ids, 1, max_tokens).alias("ids"),
        F.slice(mask, 1, max_tokens).alias("mask"),
        (F.col("n") + 1 > max_tokens).alias("truncated"),
    )


def render_conversation(
    messages: DataFrame, vocab: Vocabulary = BYTE_LEVEL, max_tokens: int | None = MAX_RENDERED_TOKENS
) -> DataFrame:
    """``(conv_id, ids, mask, truncated)`` of the valid conversations. The mask is 1
    where an assistant token is to be learned."""
    good, _ = validate_conversations(messages)
    return _render(good, vocab, max_tokens)


def render_for_completion(
    messages: DataFrame, vocab: Vocabulary = BYTE_LEVEL, max_tokens: int | None = MAX_RENDERED_TOKENS
) -> DataFrame:
    """``(conv_id, ids)`` of everything before the last assistant message, followed
    by the assistant marker. Conversations that end otherwise are left out; see
    ``validate_completion_prompt``."""
    good, _ = validate_conversations(messages)
    prompt = good.filter((F.col("last_role") == "assistant") & (F.col("turn") < F.col("last_turn")))
    return _render(prompt, vocab, max_tokens).select(
        "conv_id", F.concat("ids", _ids(ASSISTANT_START)).alias("ids")
    )
