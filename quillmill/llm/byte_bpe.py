"""Byte-level BPE by the tiktoken library over a local rank file.

Texts longer than ``PIECE_CHARS`` are cut before white space that follows other text: the split
pattern never crosses such a place and nothing behind it looks back, so the ids are those of
the whole text. Decoding joins the raw bytes of the ids; bytes that are not UTF-8 survive.

Defined cases: a null or empty text has no ids and decodes to no bytes; strings that look like
special tokens are ordinary text; repeated rows give repeated rows; an empty table gives an
empty table. The output columns replace columns of the same name, all others are kept.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_arrow, runs_by_size, texts_of
from .words import safe_pieces

PIECE_CHARS = 1 << 16


class RankCodec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE_CHARS:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        pieces = [self.encoding.encode_ordinary(p) for p in safe_pieces(text, PIECE_CHARS)]
        return np.concatenate([np.array(p, np.uint32) for p in pieces])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


_codecs: dict[tuple[str, str], RankCodec] = {}


def codec(path: str, pattern: str) -> RankCodec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = RankCodec(path, pattern)
    return _codecs[path, pattern]


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _mapped(df: DataFrame, read: str, made: list[tuple[str, T.DataType]], compute) -> DataFrame:
    """Add the ``made`` columns, computed from the values of column ``read``."""
    schema = df.schema
    for name, kind in made:
        schema = with_field(schema, name, kind)
    keep = [f.name for f in schema.fields[: len(schema.fields) - len(made)]]

    def run(batch: pa.RecordBatch):
        column = batch.column(batch.schema.get_field_index(read))
        sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
        for a, b in runs_by_size(sizes):
            part = batch.slice(a, b - a)
            values = compute(column.slice(a, b - a))
            columns = [part.column(part.schema.get_field_index(k)) for k in keep] + values
            yield pa.RecordBatch.from_arrays(columns, names=keep + [name for name, _ in made])

    return map_arrow(df, run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers."""

    def compute(column):
        c = codec(path, pattern)
        return [pa.array([c.encode(t).astype("<u4").tobytes() for t in texts_of(column)], pa.binary())]

    return _mapped(df, text, [(out, T.BinaryType())], compute)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids (as ``encode`` gives them) stand for."""

    def compute(column):
        c = codec(path, pattern)
        return [pa.array([c.decode(np.frombuffer(i or b"", "<u4")) for i in column.to_pylist()], pa.binary())]

    return _mapped(df, ids, [(out, T.BinaryType())], compute)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and, decoded from these, ``decoded``, in one pass over the texts."""

    def compute(column):
        c = codec(path, pattern)
        ids = [c.encode(t) for t in texts_of(column)]
        return [
            pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
            pa.array([c.decode(i) for i in ids], pa.binary()),
        ]

    return _mapped(df, text, [("ids", T.BinaryType()), ("decoded", T.BinaryType())], compute)
