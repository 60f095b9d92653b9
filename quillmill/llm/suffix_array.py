"""Suffix arrays by two-stage sorting, and common prefixes of neighbours, with array operations."""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray, room: int = 64) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; zeros past the end."""
    padded = np.concatenate([text, np.zeros(room + 8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text) + room, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)] << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix sorts before the one that begins a byte later. A run of equal bytes
    is decided by the byte after it."""
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    heads = text[starts].astype(np.int16)
    rises = np.append(heads[1:] > heads[:-1], False)
    return np.repeat(rises, np.diff(np.append(starts, len(text))))


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes: eight bytes at a time, each round
    only among those still equal."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    opens = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(opens)
        tied = ~opens
        tied[:-1] |= tied[1:]
        which = np.flatnonzero(tied)
        if not len(which):
            break
        part, key = order[which], words[np.minimum(order[which] + at, len(words) - 1)]
        within = np.lexsort((key, group[which]))
        order[which] = part[within]
        key, own = key[within], group[which][within]
        opens[which] = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    return order


def sort_strings(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``depth`` bytes from some places on, all inside the text, and where
    in it another string begins. Takes room for the places, not for the text."""
    order, opens = np.arange(len(places)), np.zeros(len(places), bool)
    opens[:1] = True
    which = np.arange(len(places))
    for at in range(0, depth, 8):
        begin = places[order[which]] + at
        key = np.zeros(len(begin), np.uint64)
        for k in range(min(8, depth - at)):
            key |= text[begin + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        own = np.cumsum(opens)[which]
        within = np.lexsort((key, own))
        order[which] = order[which][within]
        key = key[within]  # the groups are in order already
        opens[which] = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        tied = ~opens
        tied[:-1] |= tied[1:]
        which = np.flatnonzero(tied)
        if not len(which):
            break
    return order, opens


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of a byte array (exact over the first ``depth`` bytes).

    Suffixes smaller than their successors are sorted directly. In the bucket of a first byte
    all others come before them, in the order of their successors; so one ascending scan over
    the buckets puts each in place: what precedes the entries of a finished bucket goes to the
    end of the bucket of its own byte.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    depth = n if depth is None else depth
    direct = smaller_than_next(text)
    words = eight_bytes(text, depth + 8)
    sorted_ones = sort_directly(np.flatnonzero(direct), words, depth)
    firsts = text[sorted_ones]
    bounds = np.searchsorted(firsts, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))

    def induce(entries: np.ndarray, byte: int) -> np.ndarray:
        """Send the predecessors to their buckets; returns those of this same bucket."""
        before = entries[entries > 0] - 1
        before = before[~direct[before]]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, np.int64)
        own = np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(heads)], strict=True) if len(cuts) else ():
            if heads[a] == byte:
                own = before[a:b]
            induced[heads[a]].append(before[a:b])
        return own

    out = []
    for byte in range(256):
        front = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        while len(front):
            out.append(front)
            front = induce(front, byte)
        rest = sorted_ones[bounds[byte] : bounds[byte + 1]]
        if len(rest):
            out.append(rest)
            induce(rest, byte)
    return np.concatenate(out)


def adjacent_common(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Length, at most ``cap``, of the common prefix of each suffix with the one before it in
    ``order``; bytes past the end count as zeros, which the text itself must not hold."""
    words = eight_bytes(text, cap + 8)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, cap, 8):
        differ = words[order[alive] + at] ^ words[order[alive - 1] + at]
        same = differ == 0
        stop = alive[~same]
        bits = differ[~same]
        zeros = np.zeros(len(bits), np.int64)
        for k in range(1, 8):
            zeros += (bits >> np.uint64(64 - 8 * k)) == 0
        out[stop] = at + zeros
        alive = alive[same]
        out[alive] = at + 8
    return np.minimum(out, cap)
