"""Seeded pseudo-random numbers from md5, equal on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_md5(*parts: Column | int | str) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash32(*parts: Column | int | str) -> Column:
    """The first 32 bits of the md5 of the parts joined with ``:``."""
    return F.conv(F.substring(key_md5(*parts), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | int | str) -> Column:
    """A number strictly between 0 and 1."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(4294967296.0)
