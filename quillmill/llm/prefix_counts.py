"""Token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-level BPE encoding is the one cut into tokens of which every two neighbours are stable:
encoding the bytes of both together gives the same two tokens. So a prefix of a pre-token ends
in the one token whose predecessor, the last token of the shorter prefix, is stable with it,
and its count is the count of that shorter prefix plus one. States are kept per prefix, so
words that begin alike share them. Counts of pre-tokens add up to counts of text prefixes;
where a cut changes the pre-tokens (inside white space, contractions and added tokens) the
prefix is counted as a text that ends there.

With the counts, "how many tokens has this prefix" and "how much text fits in a budget" need no
encoding.

Defined cases: null counts as empty (0 tokens, no prefixes); strings of added tokens count as
one token, as the library does; texts of any length are taken whole; repeated rows give
repeated rows and an empty table an empty one; output columns replace columns of their name.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import BATCH_CHARS, list_array, map_arrow, runs_by_size, texts_of
from .codes import byte_symbols, kind_by
from .words import Growing, Splitter, WordTable, safe_pieces

KEPT_STATES = 800_000
KEPT_WORDS = 500_000
SHARED_BYTES = 48  # longer prefixes are not kept


class PrefixCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.splitter = Splitter(lambda char: kind_by(pre_tokenizer, char))
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.added = [t["content"] for t in model["added_tokens"]]
        back = {chr(symbol): byte for byte, symbol in enumerate(byte_symbols().tolist())}
        added = set(self.added)
        self.ids = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        vocabulary = model["model"]["vocab"]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.tails = {b[k:] for b in self.ids for k in range(len(b))}
        self.whole = {i: self.encode(b) == [i] for b, i in self.ids.items() if len(b) < 3}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[bytes, tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.totals = WordTable(KEPT_WORDS), Growing(np.int32)

    def encode(self, word: bytes) -> list[int]:
        """Merge by rank; used on the bytes of one or two tokens."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min((self.merges[p] + (p,) for p in zip(ids, ids[1:], strict=False) if p in self.merges), default=None)
            if best is None:
                break
            _, new, pair = best
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are next to each other; -1 is the word's start."""
        if left < 0:
            if right not in self.whole:
                self.whole[right] = self.encode(self.bytes_of[right]) == [right]
            return self.whole[right]
        if (known := self.pairs.get((left, right))) is None:
            known = self.pairs[left, right] = self.encode(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def table(self, word: bytes) -> list[int]:
        """Counts of the prefixes of one pre-token, from the empty one on."""
        states = self.states
        counts, last = [0], [-1]
        for i in range(1, len(word) + 1):
            short = i <= SHARED_BYTES
            state = states.get(word[:i]) if short else None
            if state is None:
                state = self.state(word, i, counts, last)
                if short:
                    states[word[:i]] = state
            counts.append(state[0])
            last.append(state[1])
        return counts

    def state(self, word: bytes, i: int, counts: list[int], last: list[int]) -> tuple[int, int]:
        size = 1
        while size <= i and (tail := word[i - size : i]) in self.tails:
            token = self.ids.get(tail)
            if token is not None and self.stable(last[i - size], token):
                return counts[i - size] + 1, token
            size += 1
        raise ValueError(f"no token ends {word[max(0, i - 40):i]!r}")

    def trim(self) -> None:
        if len(self.states) > KEPT_STATES:
            self.states = {}
        if len(self.pairs) > KEPT_STATES:
            self.pairs = {}

    def word_totals(self, words) -> np.ndarray:
        if self.known.full():
            self.forget()
        slots, new = self.known.numbers_of(words)
        if len(new):
            self.totals.extend([self.table(words.word(i).encode())[-1] for i in new.tolist()])
            self.trim()
        return self.totals.data[slots].astype(np.int64)

    def chars(self, word: str) -> list[int]:
        """Counts of the prefixes of one pre-token at its characters, the empty one left out."""
        counts = self.table(word.encode())
        at, out = 0, []
        for char in word:
            at += len(char.encode())
            out.append(counts[at])
        return out

    def inside(self, before: list[str], word: str, totals: list[int]) -> list[int]:
        """Counts at each character of ``word``, of the text that ends there. ``before`` has the
        one or two words ahead of it, ``totals`` the counts after each, led by one more."""
        out = [totals[-1] + c for c in self.chars(word)]
        if word in ("'re", "'ve", "'ll"):  # two characters of it are two pre-tokens
            out[1] = totals[-1] + self.chars("'")[-1] + self.chars(word[1])[-1]
        if before and word[0].isspace() and before[-1].isspace():  # so far one run of white space
            out[0] = totals[-2] + self.chars(before[-1] + word[0])[-1]
        return out

    def plain_prefixes(self, text: str) -> tuple[np.ndarray, int]:
        """Counts at each character and of the whole of a text without added tokens."""
        words, cut = self.words_of(text)
        out: list[int] = []
        totals = [0, 0]
        for i, word in enumerate(words):
            out += self.inside(words[max(0, i - 1) : i], word, totals)
            totals = [totals[-1], totals[-1] + int(cut[i])]
        return np.array(out, np.int32), totals[-1]

    def words_of(self, text: str) -> tuple[list[str], np.ndarray]:
        words, totals = [], []
        for piece in safe_pieces(text, BATCH_CHARS):
            cut = self.splitter.split([piece])
            words += [cut.text[a:b] for a, b in zip(cut.starts.tolist(), cut.ends.tolist(), strict=True)]
            totals.append(self.word_totals(cut))
        return words, np.concatenate(totals)

    def prefixes(self, text: str) -> np.ndarray:
        """Counts at each character of a whole text."""
        out, base = [], 0
        for part in re.split("(" + "|".join(map(re.escape, self.added)) + ")", text) if self.added else [text]:
            if part in self.added:
                previous = out[-1][1] if out else ""
                start = base - (self.plain_prefixes(previous)[1] if previous else 0)
                partial = [start + self.plain_prefixes(previous + part[:k])[1] for k in range(1, len(part))]
                base += 1
                out.append((np.array([*partial, base], np.int32), ""))
            else:
                counts, total = self.plain_prefixes(part)
                out.append((counts + base, part))
                base += total
        return np.concatenate([counts for counts, _ in out]) if out else np.zeros(0, np.int32)

    def fitting(self, words: list[str], totals: np.ndarray, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        ends = np.concatenate([[0, 0], np.cumsum(totals)])
        cut = int(np.searchsorted(ends[1:], limit, side="right")) - 1  # words that fit whole
        best = 0
        at = sum(map(len, words[: max(0, cut - 1)]))
        for i in range(max(0, cut - 1), min(len(words), cut + 3)):
            counts = self.inside(words[max(0, i - 1) : i], words[i], ends[i : i + 2].tolist())
            best = max([best, *(at + k + 1 for k, c in enumerate(counts) if c <= limit)])
            at += len(words[i])
        return best


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_texts(c: PrefixCounter, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
    """Tokens of each text, and the characters of it that fit in ``limit`` tokens."""
    counts, fits = [0] * len(texts), [0] * len(texts)
    plain = []
    for i, text in enumerate(texts):
        if len(text) > BATCH_CHARS or any(a in text for a in c.added):
            found = c.prefixes(text)
            counts[i] = int(found[-1])
            within = np.flatnonzero(found <= limit)
            fits[i] = int(within[-1]) + 1 if len(within) else 0
        else:
            plain.append(i)
    for a, b in runs_by_size([len(texts[i]) for i in plain]):
        words = c.splitter.split([texts[i] for i in plain[a:b]])
        totals = c.word_totals(words)
        bounds = np.concatenate([[0], np.cumsum(words.per_text)])
        sums = np.diff(np.concatenate([[0], np.cumsum(totals)])[bounds])
        for k, i in enumerate(plain[a:b]):
            counts[i] = int(sums[k])
            if counts[i] <= limit:
                fits[i] = len(texts[i])
                continue
            first, last = bounds[k], bounds[k + 1]
            some = min(int(last), int(first) + limit + 3)  # every word has a token
            cut = [words.text[s:e] for s, e in zip(words.starts[first:some].tolist(), words.ends[first:some].tolist(), strict=True)]
            fits[i] = c.fitting(cut, totals[first:some], limit)
    return counts, fits


def token_counts(df: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` (long) of the whole text and ``fit_chars`` (long), the length of its
    longest prefix of at most ``limit`` tokens. The text column is dropped."""
    keep = [f for f in df.schema.fields if f.name not in (text, "n_tokens", "fit_chars")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())])

    def run(batch: pa.RecordBatch):
        counts, fits = count_texts(counter(path), texts_of(batch.column(batch.schema.get_field_index(text))), limit)
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        made = [pa.array(counts, pa.int64()), pa.array(fits, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns + made, names=[*names, "n_tokens", "fit_chars"])

    return map_arrow(df, run, schema)


def prefix_counts(df: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Add ``out``: the token count of every prefix of the text that ends at a character; its
    last number is the count of the whole text. Stored once, it answers any budget question."""
    keep = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column(batch.schema.get_field_index(text)))
        for a, b in runs_by_size([len(t) for t in texts]):
            found = [counter(path).prefixes(t) for t in texts[a:b]]
            part = batch.slice(a, b - a)
            made = list_array(np.concatenate(found), np.array([len(f) for f in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), made], names=[*names, out])

    return map_arrow(df, run, schema)
