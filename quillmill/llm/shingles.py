"""Sets of word shingles of whole texts, as sorted 64-bit hashes, with array operations.

A word is hashed eight bytes at a time, every step mixed with the one before, so there are no
families of words with equal hashes as sums of powers have them; long words go to XXH3. A run of
words is hashed the same way from its words. ``word_runs`` gives the runs
themselves, for where a hash must not decide.
"""

from __future__ import annotations

import re

import numpy as np

from .words import mixed

WORDS = 5
LONG = 128  # bytes of a word that is hashed as a whole
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_CUT = re.compile(rb"[^\x20\x09-\x0d]+")
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans. ``data`` has eight bytes more than the spans use."""
    import xxhash

    sizes = ends - starts
    lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))  # the eight bytes from each on
    out = mixed(sizes.astype(np.uint64) * _STEP)
    live, at = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = np.minimum(sizes[live] - at, 8)
        out[live] = mixed((out[live] ^ (lanes[starts[live] + at] & _MASKS[left])) * _LAST + _STEP)
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64) * _STEP
    for k in range(size):
        out = mixed((out ^ words[k : k + n]) * _LAST + _STEP)
    return out


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words; a text of fewer words is one run,
    one without words has none."""
    packed = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(packed) + b"\n" + b" " * 8, np.uint8)]
    ends_of = np.cumsum([len(p) + 1 for p in packed])
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of)])
    words = word_hashes(data, starts, ends)
    runs = run_hashes(words, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(run_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_runs(text: str, size: int = WORDS) -> set[bytes]:
    """The runs of words themselves, as ``shingle_sets`` cuts them."""
    words = [w.lower() for w in _CUT.findall(text.encode())]
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
