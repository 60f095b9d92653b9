"""Learning BPE merges over a distributed table of distinct words.

One merge per Spark job would mean one job per vocabulary entry. Instead the driver
forecasts the next merges, one job replays the forecast on the words and reports how
each step changes the pair counts, and the driver accepts the steps for as long as
each is the pair that training one at a time would have picked. Steps after a wrong
guess are dropped, but what they reported makes the next forecast better.

The driver holds pair counts, at most ``MAX_PAIRS`` of them; the words stay on the
executors."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import BASE_SIZE, N_SPECIAL, Vocabulary
from ..session import discard, materialize_at, scratch_path, spread
from .vocabulary import pair_totals, word_symbols

MAX_PAIRS = 1 << 20
FORECAST = 384
FIRST_FORECAST = 24
REWRITE_EVERY = 192
CHUNK_SYMBOLS = 1_000_000  # that a task works on at once, whatever it holds

Pair = tuple[int, int]
Merge = tuple[int, int, int]
Change = tuple[int, int, int]


class PairLedger:
    """Counts of the frequent pairs. Pairs it does not hold have fewer than ``floor``, or
    just as many and do not come before ``edge``."""

    def __init__(self, counts: dict[Pair, int], floor: int, edge: Pair = (0, 0)):
        self.counts, self.floor, self.edge = counts, floor, edge
        self.heap = [(-n, pair) for pair, n in counts.items()]
        heapify(self.heap)

    def best(self) -> Pair | None:
        """The most frequent pair, the smallest ids on ties; None when a pair that is
        not held could come before it."""
        while self.heap:
            negative, pair = self.heap[0]
            if self.counts.get(pair) == -negative:
                return pair if -negative > self.floor or (-negative == self.floor and pair < self.edge) else None
            heappop(self.heap)
        return None

    def apply(self, changes: list[Change], new: int) -> None:
        """Only pairs with the new symbol can grow, and all of those are seen here."""
        for left, right, delta in changes:
            pair = (left, right)
            if pair in self.counts or left == new or right == new:
                n = self.counts.get(pair, 0) + delta
                if n > 0:
                    self.counts[pair] = n
                    heappush(self.heap, (-n, pair))
                else:
                    self.counts.pop(pair, None)

    def copy(self) -> PairLedger:
        other = PairLedger.__new__(PairLedger)
        other.counts, other.floor, other.edge, other.heap = dict(self.counts), self.floor, self.edge, list(self.heap)
        return other

    def trim(self, limit: int) -> PairLedger:
        """Forget the rarer half once there are more than ``limit`` pairs."""
        if len(self.counts) <= limit and len(self.heap) <= 4 * limit:
            return self
        ranked = sorted(self.counts.items(), key=lambda entry: (-entry[1], entry[0]))
        kept, dropped = ranked[: limit // 2], ranked[limit // 2:]
        floor, edge = self.floor, self.edge
        if dropped:
            pair, n = dropped[0]
            if n > floor:
                floor, edge = n, pair
            elif n == floor:
                edge = min(edge, pair)
        return PairLedger(dict(kept), floor, edge)


def _flatten(words: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one symbol array, each followed by -1, and the word count at each place."""
    sizes = np.asarray(words.value_lengths(), dtype=np.int64)
    values = np.asarray(words.flatten(), dtype=np.int32)
    flat = np.full(len(values) + len(sizes), -1, dtype=np.int32)
    flat[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return flat, np.repeat(np.asarray(counts, dtype=np.int64), sizes + 1)


def _unflatten(flat: np.ndarray) -> pa.Array:
    ends = np.flatnonzero(flat == -1)
    offsets = np.concatenate(([0], ends - np.arange(len(ends))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[flat != -1], pa.int32()))


def _pair_sums(flat: np.ndarray, weight: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of the pairs that start at the given places, as pair keys."""
    places = np.unique(places)
    places = places[(places >= 0) & (places + 1 < len(flat))]
    places = places[(flat[places] >= 0) & (flat[places + 1] >= 0)]
    keys = (flat[places].astype(np.int64) << 32) | flat[places + 1]
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(weight[places[order]], starts) if len(starts) else weight[:0]


def replay(flat: np.ndarray, weight: np.ndarray, merges: list[Merge], report=None, skip: int = 0) -> np.ndarray:
    """Apply merges in order, each to all its occurrences from the left. From step
    ``skip`` on, ``report(step, pair_keys, deltas)`` is told what changed."""
    for step, (left, right, new) in enumerate(merges):
        at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
        if left == right and len(at) > 1:  # of a run of places every second one merges
            first = np.concatenate(([True], np.diff(at) != 1))
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
        if len(at) == 0:
            continue
        told = report is not None and step >= skip
        if told:
            keys, lost = _pair_sums(flat, weight, np.concatenate((at - 1, at, at + 1)))
            report(step - skip, keys, -lost)
        keep = np.ones(len(flat), dtype=bool)
        keep[at + 1] = False
        flat = flat.copy() if step == 0 else flat
        flat[at] = new
        flat, weight = flat[keep], weight[keep]
        if told:
            now = at - np.arange(len(at))
            keys, won = _pair_sums(flat, weight, np.concatenate((now - 1, now)))
            report(step - skip, keys, won)
    return flat


def _touched(words: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Indices of the words that hold one of the adjacent symbol pairs."""
    flat = np.asarray(words.flatten(), dtype=np.int64)
    sizes = np.asarray(words.value_lengths(), dtype=np.int64)
    if len(flat) < 2 or len(keys) == 0:
        return np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    adjacent = (flat[:-1] << 32) | flat[1:]
    slot = np.minimum(np.searchsorted(keys, adjacent), len(keys) - 1)
    hit = (keys[slot] == adjacent) & (owner[:-1] == owner[1:])
    return np.unique(owner[:-1][hit])


def _chunks(batches: Iterator[pa.RecordBatch], symbols: int = CHUNK_SYMBOLS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Batches put together until they hold enough symbols for one pass."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(0).flatten())
        if size >= symbols:
            chunk = tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            held, size = [], 0
            del batch
            yield chunk
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def _border_keys(pending: list[Merge], ahead: list[Merge]) -> np.ndarray:
    """For each merge ahead, the symbols that met at its seam when the word table was
    last written; a word without such a seam cannot be touched by it."""
    edges: dict[int, Pair] = {}
    seams = set()
    for left, right, new in [*pending, *ahead]:
        first, last = edges.get(left, (left, left)), edges.get(right, (right, right))
        seams.add((new, first[1], last[0]))
        edges[new] = (first[0], last[1])
    wanted = {new for _, _, new in ahead}
    return np.unique(np.array([(a << 32) | b for new, a, b in seams if new in wanted], dtype=np.int64))


CHANGE_SCHEMA = "step int, left_id int, right_id int, delta bigint"
CHANGE_ARROW = pa.schema([
    ("step", pa.int32()), ("left_id", pa.int32()), ("right_id", pa.int32()), ("delta", pa.int64())
])


def step_changes(table: DataFrame, pending: list[Merge], ahead: list[Merge], floor: int = 0) -> list[list[Change]]:
    """How each merge of ``ahead``, applied in order after ``pending``, changes the
    pair counts. Changes are summed per task before they are shuffled. A pair with a new
    symbol never grows after the step that made it, so those that start below ``floor``
    stay on the executors."""
    merges, skip, keys = [*pending, *ahead], len(pending), _border_keys(pending, ahead)

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _chunks(batches):
            picked = pa.array(_touched(words, keys))
            if len(picked) == 0:
                continue
            told: list[tuple[np.ndarray, ...]] = []

            def report(step, pairs, deltas, told=told):
                told.append((np.full(len(pairs), step, dtype=np.int32), pairs, deltas))

            replay(*_flatten(words.take(picked), counts.take(picked)), merges, report, skip)
            if told:
                step, pairs, delta = (np.concatenate(c) for c in zip(*told))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(step), pa.array((pairs >> 32).astype(np.int32)),
                     pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(delta)],
                    schema=CHANGE_ARROW,
                )

    summed = (
        table.select("symbols", "n")
        .mapInArrow(changes, CHANGE_SCHEMA)
        .groupBy("step", "left_id", "right_id")
        .agg(F.sum("delta").alias("delta"))
        .filter((F.col("delta") < 0) | (F.col("delta") >= max(1, floor)))
        .toArrow()
    )
    out: list[list[Change]] = [[] for _ in ahead]
    for step, left, right, delta in zip(*(c.to_pylist() for c in summed.columns)):
        out[step].append((left, right, delta))
    return out


def apply_merges(table: DataFrame, merges: list[Merge]) -> DataFrame:
    """The word table with merges applied in order."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _chunks(batches):
            merged = _unflatten(replay(*_flatten(words, counts), merges))
            yield pa.RecordBatch.from_arrays([merged, counts], names=["symbols", "n"])

    return table.select("symbols", "n").mapInArrow(rewrite, table.select("symbols", "n").schema)


def _count(table: DataFrame, max_pairs: int) -> PairLedger:
    """Count all pairs and hold the most frequent ones."""
    top = pair_totals(table).orderBy(F.desc("n"), "left_id", "right_id").limit(max_pairs // 2).toArrow()
    left, right, n = (top.column(c).to_pylist() for c in ("left_id", "right_id", "n"))
    if len(n) < max_pairs // 2:
        return PairLedger(dict(zip(zip(left, right), n)), 0)
    return PairLedger(dict(zip(zip(left, right), n)), n[-1], (left[-1], right[-1] + 1))


class _Tokens:
    """Token bytes by id; a merge whose bytes are already a token reuses its id."""

    def __init__(self, values: list[bytes], known: dict[bytes, int]):
        self.values, self.known = values, known

    def add(self, left: int, right: int) -> tuple[int, bool]:
        value = self.values[left] + self.values[right]
        if value in self.known:
            return self.known[value], False
        self.known[value] = len(self.values)
        self.values.append(value)
        return self.known[value], True

    def copy(self) -> _Tokens:
        return _Tokens(list(self.values), dict(self.known))


def _forecast(ledger: PairLedger, tokens: _Tokens, hints: dict[Pair, list[Change]], room: int) -> list[Merge]:
    """The merges that look next. ``hints`` holds earlier reports of what a merge
    changes, with -1 for its new symbol."""
    ledger, tokens, ahead = ledger.copy(), tokens.copy(), []
    while len(ahead) < room:
        pair = ledger.best()
        if pair is None:
            break
        new, fresh = tokens.add(*pair)
        ahead.append((*pair, new))
        if not fresh:
            break  # counts of an existing symbol grow, which only a full count can tell
        named = [(new if a == -1 else a, new if b == -1 else b, d) for a, b, d in hints.get(pair, [])]
        ledger.apply([c for c in named if (c[0], c[1]) != pair] + [(*pair, -ledger.counts[pair])], new)
    return ahead


def bpe_train(
    words: DataFrame, vocab_size: int, forecast: int = FORECAST, rewrite_every: int = REWRITE_EVERY,
    max_pairs: int = MAX_PAIRS,
) -> Vocabulary:
    """Learn merges from distinct ``(token, n)`` until the vocabulary has
    ``vocab_size`` tokens or no pair is left. The most frequent pair is merged first,
    the smallest ids first on ties. ``forecast=1`` trains one merge at a time."""
    if vocab_size < BASE_SIZE:
        raise ValueError(f"vocab_size must be at least {BASE_SIZE}")
    if max_pairs < 2:
        raise ValueError("max_pairs must be at least 2")
    spark = words.sparkSession
    path = scratch_path(spark, "bpe-words")
    table = materialize_at(word_symbols(words), path)
    table = spread(table).persist()

    base = list(Vocabulary().token_values)
    tokens = _Tokens(base, {value: i for i, value in enumerate(base) if i >= N_SPECIAL})
    merges: list[Merge] = []
    pending: list[Merge] = []
    hints: dict[Pair, list[Change]] = {}
    ledger = _count(table, max_pairs)
    window = min(forecast, FIRST_FORECAST)

    def rewrite() -> None:
        nonlocal table, path
        old_table, old_path, path = table, path, scratch_path(spark, "bpe-words")
        table = spread(materialize_at(apply_merges(old_table, pending), path)).persist()
        old_table.unpersist()
        discard(spark, old_path)
        pending.clear()

    while len(tokens.values) < vocab_size:
        room = min(window, vocab_size - len(tokens.values))
        ahead = _forecast(ledger, tokens, hints, room)
        if not ahead:
            if ledger.floor == 0:
                break
            rewrite()
            ledger = _count(table, max_pairs)
            continue
        reports = step_changes(table, pending, ahead, ledger.floor)
        accepted, recount = 0, False
        for (left, right, new), changes in zip(ahead, reports):
            if ledger.best() != (left, right):
                break
            _, fresh = tokens.add(left, right)
            merges.append((left, right, new))
            pending.append((left, right, new))
            ledger.apply(changes, new)
            accepted += 1
            recount = not fresh
        hints = {
            (left, right): [(-1 if a == new else a, -1 if b == new else b, d) for a, b, d in changes]
            for (left, right, new), changes in list(zip(ahead, reports))[accepted:]
        }
        ledger = ledger.trim(max_pairs)
        window = min(forecast, max(FIRST_FORECAST, 3 * accepted))  # early guesses rarely hold for long
        if len(tokens.values) < vocab_size and (recount or len(pending) >= rewrite_every):
            rewrite()
            if recount:
                ledger = _count(table, max_pairs)
    table.unpersist()
    discard(spark, path)
    return Vocabulary(tuple(merges))
