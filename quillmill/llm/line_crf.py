"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are numbers about its own text and about the lines
before and after it; transitions tie neighbours together. Forward-backward gives the
probability of each line, and their mean weighted by length, on the logit scale of a fitted
calibration, is the document's score.

The field is fitted on at most ``sample`` labelled documents, taken by hash of the id, in which
each line carries its document's label. Of a sampled document of more than ``most_lines`` lines a run
of that many neighbouring lines, at a place taken by hash of the id, enters the fit (features
are those in the whole text). So the sample is bounded in rows, by two documented parameters, whatever
the texts are; scoring has no bound.

Defined cases: null and empty texts are one empty line; a text is scored whole, whatever its
length; repeated rows get equal scores; an empty table gives an empty one; without labels of
both kinds every score is one half; other columns are kept where they do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, runs_by_size, texts_of
from .columns import labelled_sample

SAMPLE = 3_000
MOST_LINES = 400
OWN = 13  # numbers about a line
_KINDS = {1: "#*$%&|<>", 2: "!?", 4: "0123456789", 8: ".,;:", 16: "".join(c for c in map(chr, range(0x10000)) if c.isupper())}
_KIND = np.zeros(0x110000, np.uint8)
for _bit, _chars in _KINDS.items():
    _KIND[[ord(c) for c in _chars]] |= _bit


def word_numbers(line: str) -> tuple[int, int, int]:
    """Words, distinct words, and words equal to the one before."""
    words = line.split()
    return len(words), len(set(words)), sum(map(str.__eq__, words, words[1:]))


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line the features (own, of the line before, of the line after, a one) and the
    length, and of every text the number of lines."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(lines) for lines in split])
    again = []
    for lines in split:
        seen: set[str] = set()
        for line in lines:
            again.append(line in seen)
            seen.add(line)
    lines = [line for part in split for line in part]
    points = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    kind = _KIND[points]
    symbols, marks, digits, stops, upper = (np.add.reduceat((kind & bit) > 0, starts, dtype=np.int64) for bit in _KINDS)
    words, distinct, doubled = np.array([word_numbers(line) for line in lines], np.float64).reshape(-1, 3).T
    n, size = np.maximum(1, words), np.maximum(1, sizes)
    empty = sizes == 0
    own = np.stack([
        np.log1p(sizes), np.log1p(words), symbols / n, marks / n, digits / size, stops / n, upper / size,
        distinct / n, doubled / n, sizes / n, np.array(again) & ~empty, (kind[starts] & 16) > 0, empty,
    ], 1).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[ends - counts], after[ends - 1] = 0, 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), size.astype(np.float64), counts


@dataclass
class Field:
    """Weights: ``emit`` of a line's features for good against bad, ``move`` from state to
    state, ``begin`` of the first line; ``shift`` and ``scale`` of the features and calibration."""

    mean: np.ndarray
    spread: np.ndarray
    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    slope: float = 1.0
    level: float = 0.0

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per line the probabilities of (bad, good), per place the expected moves, and per
        document the log of the sum over all labellings. Documents go side by side, line by line."""
        scores = np.clip((features - self.mean) / self.spread, -8, 8) @ self.emit
        local = np.stack([-scores / 2, scores / 2], 1)
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        starts, sizes = starts[order], counts[order]
        alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) if len(sizes) else 0)]
        forward, backward = np.zeros_like(local), np.zeros_like(local)
        moves = np.zeros((2, 2))
        for t, n in enumerate(alive):
            at = starts[:n] + t
            if t == 0:
                forward[at] = local[at] + self.begin
            else:
                m = forward[at - 1][:, :, None] + self.move[None]
                top = m.max(1)
                forward[at] = top + np.log(np.exp(m - top[:, None]).sum(1)) + local[at]
        for t in range(len(alive) - 2, -1, -1):
            n = alive[t + 1]
            at = starts[:n] + t
            m = self.move[None] + (local[at + 1] + backward[at + 1])[:, None, :]
            top = m.max(2)
            backward[at] = top + np.log(np.exp(m - top[:, :, None]).sum(2))
        last = np.cumsum(counts) - 1
        total = np.logaddexp(forward[last, 0], forward[last, 1])
        per_line = np.repeat(total, counts)
        p = np.exp(forward + backward - per_line[:, None])
        inner = np.ones(len(local), bool)
        inner[np.cumsum(counts) - counts] = False
        to = np.flatnonzero(inner)
        if len(to):
            joint = forward[to - 1][:, :, None] + self.move[None] + (local[to] + backward[to])[:, None, :] - per_line[to][:, None, None]
            moves = np.exp(joint).sum(0)
        return p, moves, total

    def raw(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of good, by length."""
        p = self.marginals(features, counts)[0][:, 1]
        bounds = np.cumsum(counts) - counts
        return np.add.reduceat(p * lengths, bounds) / np.add.reduceat(lengths, bounds)

    def score(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        share = np.clip(self.raw(features, lengths, counts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.level)))


def fit_field(features: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray, steps: int = 150, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam; every line weighs alike."""
    mean, spread = features.mean(0), features.std(0)
    mean[-1], spread[spread < 1e-9] = 0.0, 1.0
    field = Field(mean, spread, np.zeros(features.shape[1]), np.zeros((2, 2)), np.zeros(2))
    x = np.clip((features - mean) / spread, -8, 8)
    y = np.repeat(good.astype(int), counts)
    first = np.cumsum(counts) - counts
    inner = np.ones(len(x), bool)
    inner[first] = False
    true_moves = np.zeros((2, 2))
    for state in (0, 1):
        true_moves[state, state] = (inner & (y == state)).sum()
    parts = [field.emit, field.move, field.begin]
    slow, fast = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    n = len(x)
    for step in range(1, steps + 1):
        p, moves, _ = field.marginals(features, counts)
        gradients = [x.T @ (y - p[:, 1]) / n, (true_moves - moves) / n, np.array([(1 - y[first] - p[first, 0]).sum(), (y[first] - p[first, 1]).sum()]) / n]
        for w, g, a, b in zip(parts, gradients, slow, fast, strict=True):
            g = g - decay * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    share = np.clip(field.raw(features, lengths, counts), 1e-6, 1 - 1e-6)
    field.slope, field.level = calibrated(np.log(share / (1 - share)), good)
    return field


def calibrated(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton's method."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, x.T @ (good - p) - 1e-2 * (w - np.array([1.0, 0.0])))
    return float(w[0]), float(w[1])


def feature_rows(docs: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """(label, values): features and lengths of the lines of documents (label, place, text)."""

    def run(batch: pa.RecordBatch):
        labels, places, texts = batch.column(0), batch.column(1).to_pylist(), texts_of(batch.column(2))
        for a, b in runs_by_size([len(t) for t in texts]):
            x, lengths, counts = text_features(texts[a:b])
            tables = np.split(np.hstack([x, lengths[:, None]]).astype("<f4"), np.cumsum(counts)[:-1])
            values = []
            for table, place in zip(tables, places[a:b], strict=True):
                first = place % (len(table) - most_lines + 1) if len(table) > most_lines else 0
                values.append(table[first : first + most_lines].tobytes())
            yield pa.RecordBatch.from_arrays([labels.slice(a, b - a), pa.array(values, pa.binary())], names=["label", "values"])

    return map_arrow(docs, run, "label int, values binary")


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", most_lines: int = MOST_LINES
) -> Field | None:
    known = labelled_sample(labels.select(F.col(doc_id).alias("_id"), quality), F.col(quality), sample, "_id")
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("text"))
    chosen = rows.join(F.broadcast(known), "_id").select("label", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)).alias("place"), "text")
    got = sorted((r["label"], bytes(r["values"])) for r in feature_rows(chosen, most_lines).collect())
    good = np.array([label == 1 for label, _ in got])
    if not good.any() or good.all():
        return None
    tables = [np.frombuffer(v, "<f4").reshape(-1, 3 * OWN + 2).astype(float) for _, v in got]
    values = np.vstack(tables)
    return fit_field(values[:, :-1], values[:, -1], np.array([len(t) for t in tables]), good)


def score(docs: DataFrame, field: Field | None, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """Add the score of every document. The text column is dropped unless it is to be kept."""
    keep = [f for f in docs.schema.fields if f.name != out and (keep_text or f.name != text)]
    names = [f.name for f in keep]

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column(batch.schema.get_field_index(text)))
        for a, b in runs_by_size([len(t) for t in texts]):
            if field is None:
                scores = np.full(b - a, 0.5)
            else:
                scores = field.score(*text_features(texts[a:b]))
            part = batch.slice(a, b - a)
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*names, out])

    return map_arrow(docs, run, T.StructType([*keep, T.StructField(out, T.DoubleType())]))
