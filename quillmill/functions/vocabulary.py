"""A byte-level BPE vocabulary: special tokens, 256 byte symbols, then merges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from ..constants import SPECIAL_TOKENS

N_SPECIAL = len(SPECIAL_TOKENS)


def _byte_order() -> list[int]:
    """Bytes in the order of their printable stand-ins: bytes that print as
    themselves in Latin-1 come first, all others follow."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(printable)]
    return printable + rest


BYTE_ORDER = tuple(_byte_order())
BYTE_TO_ID = tuple(N_SPECIAL + BYTE_ORDER.index(b) for b in range(256))
BASE_SIZE = N_SPECIAL + 256


@dataclass(frozen=True)
class Vocabulary:
    """``merges`` holds ``(left_id, right_id, new_id)`` by rank. A vocabulary is
    bounded by its requested size, so the driver may hold one."""

    merges: tuple[tuple[int, int, int], ...] = ()

    @cached_property
    def token_values(self) -> tuple[bytes, ...]:
        """Bytes of each token by id; special tokens give their literal text."""
        values = [name.encode() for name in SPECIAL_TOKENS] + [bytes([b]) for b in BYTE_ORDER]
        for left, right, new in self.merges:
            if new == len(values):
                values.append(values[left] + values[right])
        return tuple(values)

    @property
    def size(self) -> int:
        return len(self.token_values)

    @cached_property
    def merge_rules(self) -> dict[tuple[int, int], tuple[int, int]]:
        """``(left, right) -> (rank, new_id)``."""
        return {(left, right): (rank, new) for rank, (left, right, new) in enumerate(self.merges)}

    def is_special(self, token_id: int) -> bool:
        return token_id < N_SPECIAL

    def n_bytes(self, token_id: int, mode: str = "raw") -> int:
        """Bytes a token stands for; 0 for special tokens. ``raw`` counts the
        token's own bytes; ``decoded`` decodes the token alone first, so a partial
        UTF-8 sequence counts as the replacement character."""
        if self.is_special(token_id):
            return 0
        value = self.token_values[token_id]
        if mode == "raw":
            return len(value)
        if mode == "decoded":
            return len(value.decode("utf-8", errors="replace").encode())
        raise ValueError(f"unknown mode: {mode}")


BYTE_LEVEL = Vocabulary()
