"""Toxicity by a classifier chain.

The categories are predicted one after another, each by a linear model over the words of the
text and the probabilities of the categories before it. While fitting, these probabilities come
from models that did not see the row (out-of-fold), as they will be when scoring.

Words are lower-cased runs of letters. The vocabulary is the words that tell the classes of
some category apart best in the sample, at most ``FEATURES`` of them, found with one
aggregation over the sample's words. Fitting uses at most ``sample`` labelled documents, taken
by hash of the id (a documented bound); scoring reads whole texts and needs the vocabulary only.

Defined cases: null and empty texts have no words and get the models' base probability; rows
without a label do not enter the fit; a category with labels of one kind only gets its share as
a constant; repeated rows get equal scores; an empty table gives an empty one; other columns are
kept where they do not clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, runs_by_size, texts_of

SAMPLE = 8_000
FEATURES = 600
MIN_DOCS = 4
FOLDS = 5
EXTRA = 3  # numbers about the whole text
WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


_UPPER = np.zeros(0x110000, np.uint8)
_UPPER[[k for k in range(0x10000) if chr(k).isupper()]] = 1


def text_numbers(text: str) -> list[float]:
    n = max(1, len(text))
    upper = int(_UPPER[np.frombuffer(text.encode("utf-32-le"), np.uint32)].sum(dtype=np.int64))
    return [np.log1p(len(text)) / 10, upper / n, 10 * text.count("!") / n]


@dataclass
class Linear:
    weights: np.ndarray
    level: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.level, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 150) -> Linear:
    """Logistic regression by Adam with an L2 penalty."""
    if y.all() or not y.any():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Linear(np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
    w, b = np.zeros(x.shape[1] + 1), y.mean()
    w[-1] = np.log(b / (1 - b))
    slow, fast = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        e = y - Linear(w[:-1], w[-1]).probability(x)
        g = np.append(x.T @ e / len(y) - penalty * w[:-1], e.mean())
        slow += 0.1 * (g - slow)
        fast += 0.01 * (g * g - fast)
        w += 0.05 * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-9)
    return Linear(w[:-1], float(w[-1]))


def best_limit(guess: np.ndarray, y: np.ndarray) -> float:
    """The limit of the best F1 on out-of-fold probabilities, between two of them."""
    order = np.argsort(-guess, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not y.any() or y.all():
        return 0.5
    k = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    below = guess[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(min(0.5, (guess[order[k]] + below) / 2))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)  # probability from which each category holds

    def features(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary) + EXTRA), np.float32)
        find = self.vocabulary.get
        for i, text in enumerate(texts):
            places = [j for w in words_in(text) if (j := find(w)) is not None]
            x[i, places] = 1
            x[i, len(self.vocabulary) :] = text_numbers(text)
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        """``y`` has a column per category, NaN where unknown."""
        for k in range(len(self.categories)):
            known = ~np.isnan(y[:, k])
            guess = np.zeros(len(x), np.float32)
            for f in range(FOLDS):
                held = fold == f
                model = fit_linear(x[known & ~held], y[known & ~held, k] == 1)
                guess[held] = model.probability(x[held])
            self.models.append(fit_linear(x[known], y[known, k] == 1))
            self.limits.append(best_limit(guess[known], y[known, k] == 1))
            x = np.hstack([x, guess[:, None]])

    def predict(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        out = np.zeros((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.probability(x)
            x = np.hstack([x, out[:, k : k + 1].astype(np.float32)])
        return out


def telling_words(rows: DataFrame, categories: list[str], features: int) -> list[str]:
    """Words whose presence differs most between a category's classes, by chi-square."""

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column(0))
        found = [sorted(words_in(t)) for t in texts]
        counts = [len(f) for f in found]
        labels = [pa.array(np.repeat(batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float), counts), pa.float64(), from_pandas=True) for k in range(len(categories))]
        yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), *labels], names=["word", *categories])

    shape = "word string, " + ", ".join(f"`{c}` double" for c in categories)
    counted = map_arrow(rows.select("text", *categories), run, shape).groupBy("word")
    sums = [F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"p{k}") for k, c in enumerate(categories)]
    sums += [F.count(c).alias(f"n{k}") for k, c in enumerate(categories)]
    totals = rows.agg(*[F.avg(F.when(F.col(c) == 1, 1.0).when(F.col(c) == 0, 0.0)).alias(f"q{k}") for k, c in enumerate(categories)]).first()
    scores = []
    for k in range(len(categories)):
        q = totals[f"q{k}"] or 0.5
        expected = F.col(f"n{k}") * F.lit(q)
        scores.append(F.coalesce((F.col(f"p{k}") - expected) ** 2 / (expected * F.lit(max(1e-6, 1 - q))), F.lit(0.0)))
    ranked = counted.agg(F.count(F.lit(1)).alias("docs"), *sums).where(F.col("docs") >= MIN_DOCS)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return [r["word"] for r in ranked.select("word", best.alias("score")).orderBy(F.desc("score"), "word").limit(features).collect()]


def fit(
    docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, features: int = FEATURES, doc_id: str = "doc_id", text: str = "text"
) -> Chain:
    """``labels`` has the id and a 0/1 column per category."""
    known = (
        labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(*[F.max(c).cast("int").alias(c) for c in categories])
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(known), "_id")
    vocabulary = telling_words(rows.select("text", *categories), categories, features)
    chain = Chain(categories, {w: j for j, w in enumerate(vocabulary)})

    def run(batch: pa.RecordBatch):
        x = chain.features(texts_of(batch.column(1)))
        y = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.float32) for k in range(len(categories))], 1)
        places = [np.flatnonzero(row[: len(vocabulary)]).astype("<i4").tobytes() for row in x]
        tail = [np.concatenate([x[i, len(vocabulary) :], y[i]]).astype("<f4").tobytes() for i in range(len(x))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary()), pa.array(tail, pa.binary())], names=["id", "places", "tail"])

    got = map_arrow(rows.select(F.col("_id").cast("long"), "text", *categories), run, "id long, places binary, tail binary").collect()
    got = sorted((r["id"], bytes(r["places"]), bytes(r["tail"])) for r in got)
    x = np.zeros((len(got), len(vocabulary) + EXTRA), np.float32)
    y = np.zeros((len(got), len(categories)), np.float32)
    for i, (_, places, tail) in enumerate(got):
        x[i, np.frombuffer(places, "<i4")] = 1
        numbers = np.frombuffer(tail, "<f4")
        x[i, len(vocabulary) :], y[i] = numbers[:EXTRA], numbers[EXTRA:]
    ids = np.array([g[0] for g in got], np.int64).astype(np.uint64)
    chain.fit(x, y, (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(FOLDS))
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add ``p_<category>`` for every category. The text column is dropped."""
    made = [f"p_{c}" for c in chain.categories]
    keep = [f for f in docs.schema.fields if f.name not in (text, *made)]
    names = [f.name for f in keep]

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column(batch.schema.get_field_index(text)))
        for first, last in runs_by_size([len(t) for t in texts]):
            for a in range(first, last, 1000):
                b = min(last, a + 1000)
                p = chain.predict(texts[a:b])
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(p[:, k]) for k in range(p.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return map_arrow(docs, run, T.StructType([*keep, *(T.StructField(n, T.DoubleType()) for n in made)]))
