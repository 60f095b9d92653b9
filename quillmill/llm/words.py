"""Cut whole batches of text into the pre-tokens of a byte-level BPE, with array operations.

The pattern is the one of the public rank files: contractions, runs of letters, numbers or
other characters with a space before them, and white space. Which kind a code point is, the
tokenizer library itself says (the first time it is met), so library and cut agree on every
Unicode version. A pre-token is looked up by a 64-bit hash of its code points, and its code
points are compared wherever a hash is met again (``WordTable``), so no hash decides what a word
is. Only the distinct ones of a batch become Python strings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .arrow import ranges

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _tables["up"], _tables["down"] = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)
    return _tables["up"][:n], _tables["down"][:n]


def mixed(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for every span: a difference of prefix sums."""
    up, down = powers(len(values) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(need, self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


def differ(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """Which of the spans of two arrays, of given lengths from 1 on, are not equal."""
    out = np.zeros(len(lengths), bool)
    ends = np.cumsum(lengths)
    low = 0
    while low < len(lengths):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + chunk, side="right")))
        n = lengths[low:high]
        unequal = a[ranges(a_starts[low:high], n)] != b[ranges(b_starts[low:high], n)]
        if unequal.any():
            out[low:high] = np.logical_or.reduceat(unequal, np.cumsum(n) - n)
        low = high
    return out


@dataclass
class Words:
    text: str
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    per_text: np.ndarray  # words of each text
    points: np.ndarray

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


class Splitter:
    """``kind_of`` names the kind of one character."""

    def __init__(self, kind_of: Callable[[str], int]):
        self.kind_of = kind_of
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.values = mixed(np.arange(1, 0x110001, dtype=np.uint64))

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        kind = self.kinds[points]
        if (new := kind == UNKNOWN).any():
            for point in np.unique(points[new]).tolist():
                self.kinds[point] = self.kind_of(chr(point))
            kind = self.kinds[points]
        return kind

    def split(self, texts: list[str]) -> Words:
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        ends_of = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts_of = np.concatenate([[0], ends_of[:-1]]).astype(np.int64)
        if not n:
            none = np.zeros(0, np.int64)
            return Words(text, none, none, none.astype(np.uint64), np.zeros(len(texts), np.int64), points)
        kind = self.kinds_of(points)
        closes = np.zeros(n + 1, bool)
        closes[ends_of] = True
        run = np.ones(n + 1, bool)
        run[1:n] = kind[1:] != kind[:-1]
        run |= closes
        edges = np.flatnonzero(run)
        first, last = edges[:-1], edges[1:]
        start = run
        # White space before other text: its last character stands alone or joins what follows.
        after = last[(kind[first] == SPACE) & ~closes[last]]
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        # Contractions: an apostrophe that begins a word of its own, with letters behind it.
        mark = first[(points[first] == 39) & (last - first == 1) & start[first]]
        mark = mark[~closes[mark + 1]]
        follower = points[mark + 1]
        short = mark[np.isin(follower, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))]
        start[short + 1], start[short + 2] = False, True
        mark, follower = mark[~closes[mark + 2]] if len(mark) else mark, None
        for pair in ("re", "ve", "ll"):
            long = mark[(points[mark + 1] == ord(pair[0])) & (points[mark + 2] == ord(pair[1]))]
            start[long + 1], start[long + 3] = False, True
        starts = np.flatnonzero(start[:n])
        ends = np.append(starts[1:], n)
        hashes = span_hashes(self.values[points], starts, ends)
        bounds = np.searchsorted(starts, np.concatenate([starts_of, [n]]))
        return Words(text, starts, ends, hashes, np.diff(bounds), points)


class WordTable:
    """The distinct words a worker has met, by number. A hash leads to a word, its code points
    decide: where they are others the word gets another hash until it is told apart."""

    def __init__(self, most_words: int, most_points: int = 5_000_000):
        self.most_words, self.most_points = most_words, most_points
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.points, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int32)

    def full(self) -> bool:
        """Whether it is time to start anew; a batch may be more than the table's bounds."""
        return self.starts.n > self.most_words or self.points.n > self.most_points

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 where new."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1).astype(np.int64)

    def unlike(self, words: Words, first: np.ndarray, back: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which words differ from the first of their hash, or that one from the word kept."""
        lengths = words.ends - words.starts
        out = lengths != lengths[first][back]
        again = np.flatnonzero(~out & (first[back] != np.arange(len(back))))
        out[again] = differ(words.points, words.starts[again], words.points, words.starts[first[back[again]]], lengths[again])
        known = np.flatnonzero(numbers >= 0)
        kept, mine = numbers[known], first[known]
        wrong = self.lengths.data[kept] != lengths[mine]
        same = np.flatnonzero(~wrong)
        wrong[same] = differ(words.points, words.starts[mine[same]], self.points.data, self.starts.data[kept[same]], lengths[mine[same]])
        if wrong.any():
            bad = np.zeros(len(first), bool)
            bad[known[wrong]] = True
            out |= bad[back]
        return out

    def numbers_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word, and the places of the first of each new one, which take the
        next numbers in that order."""
        import xxhash

        hashes, seed = words.hashes, 0
        while True:
            distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            numbers = self.find(distinct)
            wrong = np.flatnonzero(self.unlike(words, first, back, numbers))
            if not len(wrong):
                break
            seed += 1
            hashes = hashes.copy()
            hashes[wrong] = [xxhash.xxh3_64_intdigest(words.word(i).encode(), seed) for i in wrong.tolist()]
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self.starts.n + np.arange(len(new))
            at = np.searchsorted(self.hashes, distinct[new])
            self.hashes = np.insert(self.hashes, at, distinct[new])
            self.numbers = np.insert(self.numbers, at, numbers[new].astype(np.int32))
            starts, lengths = words.starts[first[new]], words.ends[first[new]] - words.starts[first[new]]
            self.starts.extend(self.points.n + np.cumsum(lengths) - lengths)
            self.lengths.extend(lengths)
            self.points.extend(words.points[ranges(starts, lengths)])
        return numbers[back], first[new]


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut a long text where white space follows other text: no pre-token crosses there, and
    none looks back. A stretch without such a place stays whole."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = _safe_cut(text, at + limit, at + 1)
        if cut is None:
            cut = next((i for i in range(at + limit, len(text)) if text[i].isspace() and not text[i - 1].isspace()), len(text))
        pieces.append(text[at:cut])
        at = cut
    if at < len(text) or not pieces:
        pieces.append(text[at:])
    return pieces


def _safe_cut(text: str, high: int, low: int) -> int | None:
    return next((i for i in range(high, low, -1) if text[i] in " \n\t\r" and not text[i - 1].isspace()), None)
