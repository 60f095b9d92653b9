"""Expressions over one array of logits per row; the array index is the token id.

A row holds at most one vocabulary, so nothing here needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IGNORE_INDEX, LOGIT_SOFTCAP
from .binding import let
from .hashing import uniform


def softcap(logits: Column, cap: float = LOGIT_SOFTCAP) -> Column:
    return F.transform(logits, lambda x: F.lit(cap) * F.tanh(x.cast("double") / cap))


def cross_entropy(logits: Column, target: Column) -> Column:
    """``-ln softmax(logits)[target]``; null where the target is ignored."""

    def loss(values: Column) -> Column:
        log_total = let(
            F.array_max(values).cast("double"),
            lambda peak: peak + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - peak))),
        )
        return log_total - F.element_at(values, (target + 1).cast("int")).cast("double")

    return F.when(target != IGNORE_INDEX, let(logits, loss))


def mean_cross_entropy(logits: Column, target: Column) -> Column:
    """The mean over rows whose target is not ignored, as an aggregate."""
    return F.avg(cross_entropy(logits, target))


def argmax(logits: Column) -> Column:
    """Token of the largest logit, the lowest id on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def topk(logits: Column, k: int, keep_ties: bool = False) -> Column:
    """The k largest logits as ``array<struct<logit, token>>``, best first, the
    lower id first on ties. ``keep_ties`` also keeps those equal to the k-th."""
    ranked = F.sort_array(
        F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("token")))
    )
    best = F.slice(ranked, 1, k)
    if keep_ties:
        best = let(ranked, lambda all_: let(
            F.element_at(F.slice(all_, 1, k), -1)["neg"], lambda limit: F.filter(all_, lambda r: r["neg"] <= limit)
        ))
    return F.transform(best, lambda r: F.struct((-r["neg"]).alias("logit"), r["token"].alias("token")))


def softmax(ranked: Column, temperature: float = 1.0) -> Column:
    """Probabilities of a ``topk`` result at a temperature above zero."""
    if temperature <= 0:
        raise ValueError("temperature must be positive; use argmax for zero")

    def shares(weighed: Column) -> Column:
        return let(
            F.aggregate(weighed, F.lit(0.0), lambda acc, r: acc + r["weight"]),
            lambda total: F.transform(weighed, lambda r: F.struct(r["token"], r["logit"], (r["weight"] / total).alias("prob"))),
        )

    def weights(rows: Column) -> Column:
        return let(
            F.array_max(F.transform(rows, lambda r: r["logit"])),
            lambda peak: F.transform(
                rows, lambda r: F.struct(r["token"], r["logit"], F.exp((r["logit"] - peak) / temperature).alias("weight"))
            ),
        )

    return let(let(ranked, weights), shares)


def weighted_draw(ranked: Column, group: Column, seed: int, temperature: float = 1.0) -> Column:
    """One token drawn by softmax weight (Gumbel-max over hashed uniforms), so the
    draw does not depend on partitions."""
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    if temperature == 0:
        scored = F.transform(ranked, lambda r: F.struct(r["logit"].alias("score"), (-r["token"]).alias("neg")))
    else:
        scored = F.transform(
            ranked,
            lambda r: F.struct(
                (r["logit"] / temperature - F.log(-F.log(uniform(seed, group, r["token"])))).alias("score"),
                (-r["token"]).alias("neg"),
            ),
        )
    return (-F.array_max(scored)["neg"]).cast("int")
