"""Token ids of whole texts by the tokenizers library, one call per distinct pre-token.

Byte-level BPE treats every pre-token alone, so the library is asked for the distinct ones of
a batch and the ids are laid out with array operations. The distinct words go to the library
as one text in its byte symbols, one word a line, so that it has only to cut at lines and
merge. A worker keeps what it has seen, until it has ``KEPT_WORDS`` words; then it starts anew.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .arrow import BATCH_CHARS, ranges, runs_by_size
from .words import LETTER, NUMBER, OTHER, SPACE, Growing, Splitter, Words, WordTable, safe_pieces

KEPT_WORDS = 500_000


@dataclass
class Codes:
    """Ids of several texts, one after another, and how many each has."""

    flat: np.ndarray
    counts: np.ndarray

    def each(self):
        return np.split(self.flat, np.cumsum(self.counts)[:-1]) if len(self.counts) else []


def kind_by(pre_tokenizer, char: str) -> int:
    if char == " ":
        return SPACE
    sizes = [b - a for _, (a, b) in pre_tokenizer.pre_tokenize_str(f"a{char}1!{char}!")]
    return {2: LETTER if sizes[0] == 2 else NUMBER}.get(max(sizes), OTHER if max(sizes) == 3 else SPACE)


def byte_symbols() -> np.ndarray:
    """The code point that stands for each byte: printable ones for themselves, the others
    from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = np.zeros(256, np.uint32)
    symbols[plain] = plain
    symbols[[b for b in range(256) if b not in plain]] = 256 + np.arange(256 - len(plain))
    return symbols


class Encoder:
    """Ids as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import pre_tokenizers

        self.path = path
        self.merger = self.loaded()
        cutter = self.merger.pre_tokenizer
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.added = [token.content for token in self.merger.get_added_tokens_decoder().values()]
        vocabulary = self.merger.get_vocab()
        self.symbols = byte_symbols()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.kind = np.uint16 if len(self.token_bytes) <= 1 << 16 else np.uint32
        self.splitter = Splitter(lambda char: kind_by(cutter, char))
        self.forget()

    def loaded(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, for the few texts that hold strings of added tokens."""
        return self.loaded()

    def forget(self) -> None:
        self.known = WordTable(KEPT_WORDS)
        self.ids, self.offsets, self.sizes = Growing(self.kind), Growing(np.int64), Growing(np.int32)

    def encode_words(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chosen words, one after another, and how many each has."""
        lengths = words.ends[which] - words.starts[which]
        points = words.points[ranges(words.starts[which], lengths)]
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(wide)])[np.cumsum(lengths)]
        symbols = self.symbols[np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)]
        lines = np.insert(symbols, ends[:-1], 10)
        ids = np.array(self.merger.encode_batch_fast([lines.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids)
        reached = np.cumsum(self.token_bytes[ids])
        bounds = np.searchsorted(reached, ends) + 1
        return ids, np.diff(bounds, prepend=0)

    def slots_of(self, words: Words) -> np.ndarray:
        """Where the ids of each word are kept."""
        if self.known.full():
            self.forget()
        slots, new = self.known.numbers_of(words)
        if len(new):
            ids, sizes = self.encode_words(words, new)
            self.offsets.extend(self.ids.n + np.cumsum(sizes) - sizes)
            self.ids.extend(ids)
            self.sizes.extend(sizes)
        return slots

    def encode_plain(self, texts: list[str]) -> Codes:
        """Texts without strings of added tokens."""
        words = self.splitter.split(texts)
        slots = self.slots_of(words)
        sizes = self.sizes.data[slots]
        flat = self.ids.data.take(ranges(self.offsets.data[slots], sizes)).astype(np.uint32)
        totals = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(words.per_text)])
        return Codes(flat, np.diff(totals[bounds]))

    def encode(self, texts: list[str]) -> Codes:
        """Whole texts of any length; long ones go through in pieces cut at safe places."""
        pieces, owner = [], []
        special: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):  # the library cuts these out first
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                special[i] = np.array(ids, np.uint32)
                text = ""
            for piece in safe_pieces(text, BATCH_CHARS) if len(text) > BATCH_CHARS else [text]:
                pieces.append(piece)
                owner.append(i)
        parts = [self.encode_plain(pieces[a:b]) for a, b in runs_by_size([len(p) for p in pieces])]
        if not parts:
            return Codes(np.zeros(0, np.uint32), np.zeros(0, np.int64))
        flat, sizes = np.concatenate([p.flat for p in parts]), np.concatenate([p.counts for p in parts])
        counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        if special:
            each = np.split(flat, np.cumsum(counts)[:-1])
            each = [special.get(i, ids) for i, ids in enumerate(each)]
            return Codes(np.concatenate(each), np.array([len(x) for x in each], np.int64))
        return Codes(flat, counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
