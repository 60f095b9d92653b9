"""Column helpers for whole texts, all built in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def quoted(name: str) -> str:
    """A column's name as it has to be written where dots and spaces may be in it."""
    return "`" + name.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """The runs of other than white space. Plain replacing and splitting at one character is
    several times as fast as a pattern."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are one of some ASCII characters."""
    counts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return reduce(Column.__add__, counts).cast("long")


def labelled_sample(labels: DataFrame, label: Column, bound: int, key: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids, by hash of the id: (key, label)."""
    known = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(label.cast("int")).alias("label")).where("label is not null")
    return known.orderBy(F.xxhash64(key), key).limit(bound)
