"""Packing token streams into shifted training batches.

Documents carry ``ids`` and are concatenated per rank in ``(shard, row)`` order.
The stream is cut every ``B*T+1`` tokens; a batch's inputs are all but the last of
them and its targets all but the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import inputs_of, targets_of
from ..session import materialize
from .prefix import int_div, null_safe, renamed, running_total


def repeat_epochs(docs: DataFrame, epochs: int = 1) -> DataFrame:
    """The corpus ``epochs`` times over, one pass after another: the shard becomes the
    pair of pass and shard, which orders the stream."""
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    passes = docs.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return passes.withColumn("shard", F.struct(F.col("_epoch").alias("epoch"), "shard")).drop("_epoch")


def token_offsets(
    docs: DataFrame, by: Sequence[str] = ("rank",), major: str = "shard", row: str = "row", ids: str = "ids"
) -> DataFrame:
    """Add ``off``, the stream position of each document's first token, and ``total``,
    the length of its stream. Offsets are computed on keys and lengths alone (``n_ids`` where the table
    has it), stored, and joined to the documents: while they are small enough to broadcast, which the planner
    sees by the size of the stored table, the tokens are not shuffled for them."""
    size = F.col("n_ids") if "n_ids" in docs.columns else F.size(ids)
    keys = [*by, major, row]
    lengths = docs.select(*keys, size.cast("bigint").alias("_n"))
    offsets = running_total(lengths, F.col("_n"), "off", by=by, major=major, row=row, group_total="total").drop("_n")
    stored = materialize(offsets, "offsets")
    return docs.join(renamed(stored, keys), null_safe(keys)).select(*docs.columns, "off", "total")


class BatchShape:
    """Where the rows of the batches lie in a token stream. Batch row R starts at token
    ``start(R)`` and covers ``T+1`` tokens: its inputs and, one further, its targets."""

    def __init__(self, batch_size: int, seq_len: int, overlap: bool = False):
        self.rows, self.width = batch_size, seq_len + 1
        self.seq_len, self.batch_tokens = seq_len, batch_size * seq_len + 1
        self.stride = self.batch_tokens - 1 if overlap else self.batch_tokens

    def full_batches(self, total: Column) -> Column:
        return F.greatest(F.lit(0), int_div(total - self.batch_tokens + self.stride, self.stride))

    def start(self, r: Column) -> Column:
        return int_div(r, self.rows) * self.stride + r % self.rows * self.seq_len

    def last_row_at(self, position: Column) -> Column:
        """The last row that starts at or before a position."""
        batch = int_div(position, self.stride)
        return batch * self.rows + F.least(int_div(position - batch * self.stride, self.seq_len), F.lit(self.rows - 1))

    def first_row_with(self, position: Column) -> Column:
        """The first row that reaches a position."""
        ahead = position - self.width
        return F.when(ahead < 0, F.lit(0)).otherwise(self.last_row_at(ahead) + 1)


def _part(ids: str, begin: Column, end: Column) -> Column:
    """The tokens of a document between two stream positions."""
    off = F.col("off")
    begin, end = F.greatest(off, begin), F.least(off + F.size(ids), end)
    return F.slice(ids, (begin - off + 1).cast("int"), (end - begin).cast("int"))


def _in_order(parts: str) -> Column:
    return F.flatten(F.transform(parts, lambda p: p["seg"]))


TAIL = -1


def pack_rows(
    placed: DataFrame, shape: BatchShape, by: Sequence[str] = ("rank",), ids: str = "ids",
    limit_batches: int | None = None, tail: bool = False, state: Sequence[str] = (),
) -> DataFrame:
    """Batch rows ``(by, r, tokens)`` of documents that carry ``off`` and ``total``, and the columns
    ``state`` of the document that gave the last token of the row.
    Each document gives one segment per batch row it reaches, and a group is one batch
    row of at most ``T+1`` tokens, whatever the number of ranks. Unfilled batches are
    not formed; ``tail`` puts what is left, less than a batch, into row ``TAIL``."""
    full = shape.full_batches(F.col("total"))
    if limit_batches is not None:
        full = F.least(full, F.lit(limit_batches))
    first = shape.first_row_with(F.col("off"))
    last = F.least(shape.last_row_at(F.col("off") + F.size(ids) - 1), full * shape.rows - 1)
    none = F.array().cast("array<bigint>")
    reached = F.when(first <= last, F.sequence(first, last)).otherwise(none)
    begin, end = shape.start(F.col("r")), shape.start(F.col("r")) + shape.width
    if tail:
        left = full * shape.stride
        late = F.col("off") + F.size(ids) > left
        reached = F.concat(reached, F.when(late, F.array(F.lit(TAIL).cast("bigint"))).otherwise(none))
        begin = F.when(F.col("r") == TAIL, left).otherwise(begin)
        end = F.when(F.col("r") == TAIL, F.col("total")).otherwise(end)
    return (
        placed.filter(F.size(ids) > 0)
        .withColumn("r", F.explode(reached))
        .select(*by, "r", F.struct(F.greatest("off", begin).alias("at"), _part(ids, begin, end).alias("seg"), *state).alias("part"))
        .groupBy(*by, "r")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(*by, "r", _in_order("parts").alias("tokens"), *(F.element_at("parts", -1)[c].alias(c) for c in state))
    )


def batch_rows(rows: DataFrame, shape: BatchShape, by: Sequence[str] = ("rank",), state: Sequence[str] = ()) -> DataFrame:
    """Batch rows as inputs and targets."""
    return rows.select(
        *by,
        int_div(F.col("r"), shape.rows).alias("batch"),
        (F.col("r") % shape.rows).cast("int").alias("row_in_batch"),
        F.slice("tokens", 1, shape.seq_len).alias("inputs"),
        F.slice("tokens", 2, shape.seq_len).alias("targets"),
        *state,
    )


def pack_sequences(
    docs: DataFrame,
    batch_size: int,
    seq_len: int,
    by: Sequence[str] = ("rank",),
    major: str = "shard",
    row: str = "row",
    ids: str = "ids",
    overlap: bool = False,
    limit_batches: int | None = None,
) -> DataFrame:
    """Training batches ``(by, batch, row_in_batch, inputs, targets)``; an incomplete
    tail is not emitted. By default the last token of a batch is only a target;
    ``overlap`` also makes it the first input of the next one.

    Where the documents have a ``row_group``, every row also says from which ``(major, row_group)`` its last
    token came. That of a batch's last row is the loader's state after the batch: see ``loader_state``.

    ``docs`` is read twice, for lengths and for tokens, so pass a stored table with
    ``n_ids`` when its ids are costly to compute."""
    shape = BatchShape(batch_size, seq_len, overlap)
    state = [major, "row_group"] if "row_group" in docs.columns else []
    placed = token_offsets(docs, by, major, row, ids)
    return batch_rows(pack_rows(placed, shape, by, ids, limit_batches, state=state), shape, by, state)


def loader_state(batches: DataFrame, batch_size: int, by: Sequence[str] = ("rank",), major: str = "shard") -> DataFrame:
    """``(by, batch, major, row_group)``: where the tokens of each batch end. Reading goes on after such a
    position with ``after_row_group``; what a row group has left beyond the batch is skipped, and nothing is
    read again."""
    return batches.filter(F.col("row_in_batch") == batch_size - 1).select(*by, "batch", major, "row_group")


def next_token_targets(df: DataFrame, ids: str = "ids") -> DataFrame:
    """One row per position with the token there and the one after it; the last
    position has no target and gives no row."""
    keep = [c for c in df.columns if c != ids]
    pairs = F.arrays_zip(
        inputs_of(F.col(ids)).alias("token_id"), targets_of(F.col(ids)).alias("target_id")
    )
    return df.select(*keep, F.posexplode(pairs).alias("pos", "pair")).select(
        *keep, "pos", "pair.token_id", "pair.target_id"
    )
