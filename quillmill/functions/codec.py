"""Encode text to token ids and back.

Encoding is narrow: the JVM splits the text, an Arrow function maps the distinct
pieces of a batch to ids, and nothing is shuffled. Decoding stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..constants import SPECIAL_TOKENS, special_id
from .text import pretokenize
from .vocabulary import BYTE_LEVEL, BYTE_TO_ID, Vocabulary

LONG_PIECE = 256
# Bytes of text that are encoded at once; a longer text is encoded alone. Ids of a whole Arrow batch would
# take many times the memory of its texts.
BYTES_PER_PASS = 1 << 21
NO_RANK = np.iinfo(np.int64).max


def merge_symbols(ids: list[int], rules: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge one long piece: lowest rank first and leftmost among equals."""
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = []

    def offer(i: int, j: int, push) -> None:
        if i >= 0 and j < n:
            rule = rules.get((ids[i], ids[j]))
            if rule is not None:
                push((rule[0], i, ids[i], ids[j], rule[1]))

    for i in range(n - 1):
        offer(i, i + 1, queue.append)
    heapify(queue)
    while queue:
        _, i, left, right, new = heappop(queue)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # one of the two was merged meanwhile
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        push = lambda entry: heappush(queue, entry)
        offer(before[i], i, push)
        offer(i, after[i], push)
    return [x for x in ids if x >= 0]


class PieceEncoder:
    """Ids of many pieces at once. Every pass merges the lowest-ranked pair of every
    short piece in one go; pieces that have nothing left to merge leave the set."""

    def __init__(self, vocab: Vocabulary):
        self.rules = vocab.merge_rules
        entries = sorted(((left << 32) | right, rank, new) for (left, right), (rank, new) in self.rules.items())
        self.keys, self.ranks, self.news = (
            np.array([e[i] for e in entries], dtype=np.int64) for i in range(3)
        )

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each piece starts in it and how many it has."""
        offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset: pieces.offset + len(pieces) + 1]
        size = np.diff(offsets).astype(np.int64)
        data = pieces.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.empty(0, np.uint8)
        pool = np.array(BYTE_TO_ID, dtype=np.int32)[raw]
        start = (offsets[:-1] - offsets[0]).astype(np.int64)
        if len(self.keys):
            pool, start, size = self._merge(pool, start, size)
        return self._place_specials(pieces, pool, start, size)

    def _merge(self, flat, start, size):
        parts, n_done = [], 0
        new_start, new_size = np.zeros_like(start), size.copy()

        def finish(words, sizes, symbols):
            nonlocal n_done
            new_size[words] = sizes
            new_start[words] = n_done + np.cumsum(sizes) - sizes
            parts.append(symbols.astype(np.int32))
            n_done += len(symbols)

        for word in np.flatnonzero(size > LONG_PIECE):
            ids = merge_symbols(flat[start[word]: start[word] + size[word]].tolist(), self.rules)
            finish(np.array([word]), np.array([len(ids)]), np.array(ids, dtype=np.int32))

        words = np.flatnonzero(size <= LONG_PIECE)
        sizes = size[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols = flat[np.repeat(start[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))].astype(np.int64)
        while len(words):
            rank = np.full(len(symbols), NO_RANK, dtype=np.int64)
            key = (symbols[:-1] << 32) | symbols[1:]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[slot] == key) & (owner[:-1] == owner[1:])
            rank[:-1][known] = self.ranks[slot[known]]

            lowest = np.full(len(words), NO_RANK, dtype=np.int64)
            filled = np.flatnonzero(sizes)
            if len(filled):
                lowest[filled] = np.minimum.reduceat(rank, (np.cumsum(sizes) - sizes)[filled])
            done = lowest == NO_RANK
            if done.any():
                out = done[owner]
                finish(words[done], sizes[done], symbols[out])
                words, sizes, lowest = words[~done], sizes[~done], lowest[~done]
                slot, rank, symbols = np.append(slot, 0)[~out], rank[~out], symbols[~out]
                owner = np.repeat(np.arange(len(words)), sizes)
                if not len(words):
                    break
            at = np.flatnonzero(rank == lowest[owner])
            first = np.concatenate(([True], np.diff(at) != 1))
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols[at] = self.news[slot[at]]
            sizes = sizes - np.bincount(owner[at], minlength=len(words))
            symbols, owner = symbols[keep], owner[keep]
        return (np.concatenate(parts) if parts else flat), new_start, new_size

    @staticmethod
    def _place_specials(pieces, pool, start, size):
        found = np.asarray(pc.index_in(pieces, pa.array(SPECIAL_TOKENS)).fill_null(-1))
        special = np.flatnonzero(found >= 0)
        if len(special):
            start[special], size[special] = len(pool) + np.arange(len(special)), 1
            pool = np.concatenate((pool, found[special].astype(np.int32)))
        return pool, start, size


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)


def _rebuild(offsets: np.ndarray, values: pa.Array, nulls: np.ndarray) -> pa.Array:
    marks = pa.array(offsets, pa.int32(), mask=np.append(nulls, False))
    return pa.ListArray.from_arrays(marks, values)


def _byte_ends(rows: pa.Array) -> np.ndarray:
    """Where the text of each row of (nested) lists of pieces begins, and where the last one ends."""
    ends, values = np.arange(len(rows) + 1), rows
    while len(values):
        ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[ends + values.offset]
        if not pa.types.is_list(values.type):
            return ends
        values = values.values
    return np.zeros(len(rows) + 1, dtype=np.int32)


def _passes(rows: pa.Array) -> Iterator[pa.Array]:
    """A batch as runs of rows of at most ``BYTES_PER_PASS`` each, or one row."""
    ends = _byte_ends(rows).astype(np.int64)
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES_PER_PASS, side="right")) - 1)
        yield rows.slice(first, last - first)
        first = last


def _encode_lists(lists: pa.Array, encode) -> pa.Array:
    """``list<string>`` pieces of one pass to ``list<int>`` ids, each distinct piece once."""
    coded = lists.flatten().dictionary_encode()
    pool, start, size = encode(coded.dictionary)
    which = np.asarray(coded.indices, dtype=np.int64)
    lens = size[which]
    ends = np.concatenate(([0], np.cumsum(lens)))
    source = np.repeat(start[which] - ends[:-1], lens) + np.arange(ends[-1])
    rows = np.concatenate(([0], np.cumsum(_lengths(lists))))
    return _rebuild(ends[rows], pa.array(pool[source], pa.int32()), np.asarray(lists.is_null()))


IDS = ArrayType(IntegerType())


def _once(function):
    """Keep the optimizer from copying the call, for instance into the filter it
    infers below an explode: every text is encoded a single time."""
    return function.asNondeterministic()


def _ids_function(vocab: Vocabulary):
    encode = PieceEncoder(vocab)

    def ids_of_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for pieces in _passes(batch):
                yield _encode_lists(pieces, encode)

    return _once(F.arrow_udf(ids_of_pieces, returnType=IDS))


def _nested_ids_function(vocab: Vocabulary):
    encode = PieceEncoder(vocab)

    def ids_of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _passes(batch):
                offsets = np.concatenate(([0], np.cumsum(_lengths(texts))))
                yield _rebuild(offsets, _encode_lists(texts.flatten(), encode), np.asarray(texts.is_null()))

    return _once(F.arrow_udf(ids_of_texts, returnType=ArrayType(IDS)))


def _pieces(text: Column, vocab: Vocabulary, allow_special: bool) -> Column:
    # Without merges the split cannot change the ids, so the text is one piece.
    if not vocab.merges and not allow_special:
        return F.when(text.isNotNull(), F.array(text))
    return pretokenize(text, allow_special)


def _end_id(end: str | int | None) -> Column:
    if end is None:
        return F.array().cast("array<int>")
    return F.array(F.lit(special_id(end) if isinstance(end, str) else int(end)))


def bpe_encode(
    text: Column,
    vocab: Vocabulary = BYTE_LEVEL,
    prepend: str | int | None = None,
    append: str | int | None = None,
    allow_special: bool = False,
) -> Column:
    """Token ids of a text, with an optional special token (by name or id) at
    either end. A null text gives null ids."""
    ids = _ids_function(vocab)(_pieces(text, vocab, allow_special))
    if prepend is None and append is None:
        return ids
    return F.concat(_end_id(prepend), ids, _end_id(append))


def bpe_encode_each(texts: Column, vocab: Vocabulary = BYTE_LEVEL, prepend: str | int | None = None) -> Column:
    """Token ids of each text of an array column, still one row."""
    pieces = F.transform(texts, lambda t: _pieces(t, vocab, False))
    ids = _nested_ids_function(vocab)(pieces)
    if prepend is None:
        return ids
    return F.transform(ids, lambda seq: F.concat(_end_id(prepend), seq))


def bpe_decode(ids: Column, vocab: Vocabulary = BYTE_LEVEL) -> Column:
    """Text of token ids; special tokens keep their text and broken UTF-8 becomes
    the replacement character."""
    table = F.split(F.lit(",".join(value.hex() for value in vocab.token_values)), ",")
    hexed = F.array_join(F.transform(ids, lambda x: F.element_at(table, x + 1)), "")
    return F.make_valid_utf8(F.unhex(hexed).cast("string"))


def byte_symbols(token: Column) -> Column:
    """Base symbols of a pre-token: the ids of its UTF-8 bytes."""
    return _ids_function(BYTE_LEVEL)(F.when(token.isNotNull(), F.array(token)))
