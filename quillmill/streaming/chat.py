"""Chat contexts from a stream of messages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import ASSISTANT_END, ASSISTANT_START, BOS, USER_END, USER_START
from ..functions.codec import bpe_encode
from ..functions.text import strip
from ..functions.vocabulary import BYTE_LEVEL, Vocabulary

# --- fixed values: chat commands --------------------------------------------------
QUIT_WORDS = ("quit", "exit")
CLEAR_WORD = "clear"

PLACE_SCHEMA = "conv_id bigint, turn bigint, segment bigint, start bigint"
PLACE_STATE = "segment bigint, length bigint, ended boolean, waiting boolean, turn bigint"
HELD_STATE = "turn bigint, kind string, n_ids bigint"


def chat_events(messages: DataFrame, vocab: Vocabulary = BYTE_LEVEL, keep: Sequence[str] = ()) -> DataFrame:
    """Messages as ``(conv_id, turn, kind, ids)`` and the columns ``keep``: kind is ``ask``, ``clear``,
    ``quit``, ``reply``, or ``skip`` for blank input and other roles, which add nothing but fill their turn."""
    said = strip(F.col("text"))
    word = F.lower(said)
    kind = (
        F.when(F.col("role") == "assistant", "reply")
        .when(F.col("role").isNull() | (F.col("role") != "user") | said.isNull() | (said == ""), "skip")
        .when(word.isin(*QUIT_WORDS), "quit")
        .when(word == CLEAR_WORD, "clear")
        .otherwise("ask")
    )
    body = F.when(F.col("role") == "user", said).otherwise(F.col("text"))
    events = messages.withColumns({"kind": kind, "_body": F.when(kind != "skip", body)})
    ids = bpe_encode(F.col("_body"), vocab)
    asked = F.concat(F.array(F.lit(USER_START)), ids, F.array(F.lit(USER_END), F.lit(ASSISTANT_START)))
    ended = F.element_at(ids, -1) == ASSISTANT_END
    replied = F.when((F.size(ids) > 0) & ended, ids).otherwise(F.concat(ids, F.array(F.lit(ASSISTANT_END))))
    return events.select(
        "conv_id", "turn", "kind",
        F.when(F.col("kind") == "ask", asked).when(F.col("kind") == "reply", replied).alias("ids"), *keep,
    )


class _Context(StatefulProcessor):
    """Places the events of one conversation in the order of their turns. Events ahead of a turn that is
    still missing are held as a list; of a conversation that has ended only the fact is kept."""

    def __init__(self, first_turn: int, idle_ms: int | None):
        self.first_turn, self.idle_ms = first_turn, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE_STATE)
        self.held = handle.getListState("held", HELD_STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = self.place.get() if self.place.exists() else (0, 1, False, False, self.first_turn)
        events, latest = [], None
        for frame in rows:
            events.extend(zip(frame["turn"].tolist(), frame["kind"].tolist(), frame["n_ids"].tolist()))
            if self.idle_ms is not None and len(frame):
                latest = max(int(frame["at_ms"].max()), latest or 0)
        if not state[2]:
            waited = list(self.held.get()) if self.held.exists() else []
            out, state, ahead = self._walk(events + [tuple(e) for e in waited], state, wait=True)
            self._hold(ahead)
            if out:
                yield self._frame(key, out)
        self.place.update(state)
        if latest is not None:
            for timer in list(self.handle.listTimers()):
                latest = max(latest, timer - self.idle_ms)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """An idle conversation: what still waits is placed without the missing turns, and its state goes."""
        if self.held.exists() and self.place.exists():
            out, _, _ = self._walk([tuple(e) for e in self.held.get()], self.place.get(), wait=False)
            if out:
                yield self._frame(key, out)
        self.held.clear()
        self.place.clear()

    def _hold(self, ahead: list) -> None:
        if ahead:
            self.held.put(ahead)
        else:
            self.held.clear()

    @staticmethod
    def _walk(events: list, state: tuple, wait: bool) -> tuple[list, tuple, list]:
        """Places of the events that can be placed, the state after them, and the events still ahead."""
        segment, length, ended, waiting, turn = state
        out, ahead = [], []
        for at, kind, n_ids in sorted(events):
            if ended or at < turn:
                continue
            if wait and at > turn:
                ahead.append((int(at), kind, int(n_ids)))
                continue
            turn = at + 1
            if kind == "quit":
                ended, ahead = True, []
            elif kind == "clear":
                segment, length, waiting = segment + 1, 1, False
            elif kind == "ask" or (kind == "reply" and waiting):
                out.append((at, segment, length))
                length += n_ids
                waiting = kind == "ask"
        return out, (int(segment), int(length), bool(ended), bool(waiting), int(turn)), ahead

    @staticmethod
    def _frame(key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=["conv_id", "turn", "segment", "start"])

    def close(self) -> None:
        pass


def stream_chat_context(
    events: DataFrame, first_turn: int = 0, at: str | None = None, idle: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Where each event goes in the context of its conversation: ``segment`` counts
    the clears before it and ``start`` is its token position in the segment, after
    the BOS that opens it. Events that add nothing have no row.

    Events are placed by turn, from ``first_turn`` on, whatever micro-batches bring them: an event ahead of a
    missing turn waits for it. Of a repeated turn the first one counts, and inside one micro-batch the least kind and
    length; events without a turn are left out. ``at`` names a
    timestamp column of the events. With it a conversation expires when the watermark (``late`` behind the newest
    event) is ``idle`` past its last event: what waits is then placed without the missing turns, and all state
    goes. Without it a gap waits for ever and ended conversations leave one row of state each.

    Only turn numbers, kinds and lengths pass through the stateful operator, and its
    state is five numbers per conversation and the events that wait; the tokens themselves never meet in one task.
    Start the query inside ``state_store``, as ``append_parquet`` does."""
    light = events.filter(F.col("turn").isNotNull()).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "kind",
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"),
        *([F.col(at).alias("at"), F.unix_millis(at).alias("at_ms")] if at else []),
    )
    if at:
        light = light.filter(F.col("at").isNotNull()).withWatermark("at", late)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if at else None
    return light.groupBy("conv_id").transformWithStateInPandas(
        _Context(first_turn, idle_ms), PLACE_SCHEMA, "append", "eventTime" if at else "none"
    )


def placed_events(places: DataFrame, events: DataFrame) -> DataFrame:
    """Placed events with their tokens."""
    return places.join(events.select("conv_id", "turn", "ids"), ["conv_id", "turn"])


def chat_contexts(placed: DataFrame) -> DataFrame:
    """Whole contexts per conversation and segment. One context is one row, so use it
    on the conversations that are about to be continued."""
    turns = F.sort_array(F.collect_list(F.struct("start", "ids")))
    return placed.groupBy("conv_id", "segment").agg(
        F.concat(F.array(F.lit(BOS)), F.flatten(F.transform(turns, lambda t: t["ids"]))).alias("ids")
    )
