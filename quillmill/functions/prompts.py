"""Few-shot prompt text as column expressions.

``shots`` is an array of item structs with the same fields as the item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _solved(shots: Column, solution) -> Column:
    """The solved examples, each followed by a blank line."""
    return F.array_join(F.transform(shots, lambda s: F.concat(solution(s), F.lit("\n\n"))), "")


def render_mc(query: Column, choices: Column, delim: Column, shots: Column) -> Column:
    """One prompt per choice: same query, different continuation."""
    head = _solved(shots, lambda s: F.concat(s["query"], delim, s["choices"][s["gold"]]))
    return F.transform(choices, lambda choice: F.concat(head, query, delim, choice))


def render_schema(options: Column, continuation: Column, delim: Column, shots: Column) -> Column:
    """One prompt per context option: different context, same continuation."""
    head = _solved(
        shots, lambda s: F.concat(s["context_options"][s["gold"]], delim, s["continuation"])
    )
    return F.transform(options, lambda option: F.concat(head, option, delim, continuation))


def render_lm(context: Column, continuation: Column, delim: Column, shots: Column) -> Column:
    """Two prompts: without the continuation (stripped) and with it."""
    head = _solved(shots, lambda s: F.concat(strip(s["context"]), delim, s["continuation"]))
    without = F.concat(head, strip(context), delim)
    return F.array(strip(without), F.concat(without, continuation))
