"""Quality rules learned as a decision list over text statistics.

Statistics are built-in column expressions over whole texts. From the statistics of labelled
documents sequential covering learns rules against bad ones: a rule grows by the threshold
condition of the highest information gain until it covers no good document, is pruned from its
end on held-back rows, and is kept while it is precise there; the rows it covers go and the
next rule is grown. The list comes out as one ordered ``CASE WHEN`` expression, so applying it
is a projection.

Fitting uses at most ``sample`` labelled documents, taken by hash of the id (a parameter); the
sample is joined by broadcast, and its statistics, a row of numbers per document, are collected.

Defined cases: null and empty texts have no words and fail the base rule; ties between
conditions go to the first by name; repeated rows are judged alike; without labels, or with
labels of one kind only, the list is empty and keeps all that passes the base rule; an empty
table gives an empty one; other columns are kept, whatever their names, but those that a
statistic, ``base_failed``, ``rule`` or ``kept`` replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .columns import BLANKS, count_chars, labelled_sample, quoted, words

SAMPLE = 20_000
MIN_WORDS = 50
FEW = 32  # repeated windows that are looked up one by one
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "mark_rate", "distinct_rate"]


def _sorted_places(w: Column) -> Column:
    """Places of repeated windows by sorting all windows by hash: equal neighbours."""
    windows = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def repeated(s):
        hit = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(hit, lambda x: x["at"]))

    return let(windows, repeated)


def _covered_words(places: Column) -> Column:
    """Words that windows of three at sorted places cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"]
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its statistics; they also replace columns of their names.

    Words in repeated windows: windows of three words are hashed, and equal neighbours
    among the sorted hashes are repeated ones. Where they are few, their places are looked up,
    otherwise all windows are sorted with their places, so the work stays near linear in any
    text.

    All statistics of a document leave as one generated row: a filter on what a generator makes
    stays above it, so their expressions are evaluated once a document and never move into a
    scan's filter or another expression's lambda."""
    kept = [c for c in docs.columns if c != text and c not in [*BASE, *RATES]]
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")
    # Columns of the input travel under numbers, so that none can clash with a name used here.
    row = F.struct(F.lit(0).alias("c"), *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)))
    first = docs.select(row.alias("row"), t.alias("t"), words(F.col(quoted(text))).alias("w"), lines.alias("l"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    none = F.array().cast("array<bigint>")
    second = first.select(
        "row", F.size("w").cast("long").alias("n_words"), (F.length("t") - count_chars(F.col("t"), BLANKS)).alias("word_chars"),
        count_chars(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, none).otherwise(hashes).alias("h"),
        F.size("l").alias("lines"), F.size(F.array_distinct("w")).alias("distinct"),
        count_chars(F.col("t"), "!?").alias("marks"),
    )
    third = second.withColumn("s", F.sort_array("h")).withColumn(
        "d", F.array_distinct(F.filter("s", lambda x, i: x == F.get("s", i + 1)))
    )
    found = F.filter(F.transform("h", lambda h, i: F.when(F.array_contains("d", h), i)), lambda i: i.isNotNull())
    repeats = (
        F.when(F.size("d") == 0, F.lit(0)).when(F.size("d") <= FEW, _covered_words(found)).otherwise(_covered_words(_sorted_places(F.col("h"))))
    )
    fourth = third.withColumn("n_repeat_words", repeats.cast("long"))

    def rate(part: str, whole: str) -> Column:
        return F.round(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0), 6)

    rates = {
        "symbol_rate": rate("n_symbols", "word_chars"), "dup_line_rate": rate("n_dup_lines", "lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"), "word_length": rate("word_chars", "n_words"),
        "mark_rate": rate("marks", "word_chars"), "distinct_rate": rate("distinct", "n_words"),
    }
    found = F.array(F.struct(*BASE, *(value.alias(name) for name, value in rates.items())))
    fifth = fourth.select("row", F.inline(found))
    return fifth.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), *BASE, *RATES)


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        v = values[:, names.index(self.name)]
        return v >= self.limit if self.above else v <= self.limit

    def column(self) -> Column:
        return F.col(self.name) >= self.limit if self.above else F.col(self.name) <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.limit:g}"


Rule = list[Condition]


def covered(rule: Rule, values: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(values), bool)
    for condition in rule:
        out &= condition.holds(values, names)
    return out


def best_condition(values: np.ndarray, bad: np.ndarray, names: list[str]) -> Condition | None:
    """The condition of the highest gain: bad rows kept times the bits their share rises by."""
    total, n = int(bad.sum()), len(bad)
    found, best = None, 1e-9
    for j, name in enumerate(names):
        order = np.argsort(values[:, j], kind="stable")
        v, b = values[order, j], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] != v[:-1])  # between cut and cut + 1
        for above in (False, True):
            p = (total - b[cut] if above else b[cut]).astype(float)
            size = n - cut - 1 if above else cut + 1
            gain = p * (np.log2(np.maximum(p, 1e-12) / size) - np.log2(total / n))
            if len(gain) and gain.max() > best:
                k = cut[int(gain.argmax())]
                best = float(gain.max())
                found = Condition(name, above, float((v[k] + v[k + 1]) / 2))
    return found


def grow(values: np.ndarray, bad: np.ndarray, names: list[str], most: int = 4) -> Rule:
    rule: Rule = []
    while len(rule) < most and bad.any() and not bad.all():
        condition = best_condition(values, bad, names)
        if condition is None:
            break
        rule.append(condition)
        inside = condition.holds(values, names)
        values, bad = values[inside], bad[inside]
    return rule


def prune(rule: Rule, values: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The beginning of the rule that is best on rows it was not grown on."""

    def worth(k: int) -> tuple[float, int]:
        inside = covered(rule[:k], values, names)
        p = int(bad[inside].sum())
        return (2 * p - int(inside.sum())) / max(1, int(inside.sum())), p

    return rule[: max(range(1, len(rule) + 1), key=worth)] if rule else rule


def learn(values: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, most: int = 12) -> list[Rule]:
    """Rules in order. Every third row prunes and judges, the others grow."""
    rules: list[Rule] = []
    held = np.arange(len(bad)) % 3 == 2
    while len(rules) < most and bad.sum() >= 5:
        rule = prune(grow(values[~held], bad[~held], names), values[held], bad[held], names)
        inside = covered(rule, values, names)
        judged = inside & held
        if not rule or not bad[judged].any() or bad[judged].mean() < precision or bad[inside].mean() < precision:
            break
        rules.append(rule)
        values, bad, held = values[~inside], bad[~inside], held[~inside]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule against the document; null if none applies."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        hit = F.lit(True)
        for condition in rules[k]:
            hit = hit & condition.column()
        out = F.when(hit, F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> list[Rule]:
    """Learn the list from documents that pass the base rule."""
    known = labelled_sample(labels.select(F.col(doc_id).alias("_id"), quality), F.col(quality), sample, "_id")
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known), "_id")
    rows = statistics(chosen).where(~base_failed()).select(F.xxhash64("_id"), "_id", "label", *RATES).collect()
    numbers = np.array([r[2:] for r in sorted(rows, key=tuple)], float)
    return learn(numbers[:, 1:], numbers[:, 0] == 0, RATES) if len(numbers) else []


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, the ``rule`` against the document and ``kept``."""
    return statistics(docs, text).withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
