"""Ordered running totals without a window over an unbounded group.

Rows are ordered by ``(major, row)`` inside each ``by`` group. Their keys and values alone are dealt
into ranges of that order which hold about as many rows each, whatever the values of ``row`` are and however
large one group is. A window runs over each range, another over one row per range and group, and the two are
added up. Other columns of the table are joined to the result by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 16384
MOST_RANGES = 4096  # beyond BLOCK * MOST_RANGES rows the ranges grow

_JOIN_OP = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def int_div(value: Column, by: int) -> Column:
    """Integer division; unlike ``floor(a / b)`` it never goes through a double."""
    return F.call_function("div", value, F.lit(by))


def renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def null_safe(keys: Sequence[str]) -> Column:
    """The join condition with ``renamed`` keys under which a null key meets itself."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def ranged(df: DataFrame, order: Sequence[str], block: int = BLOCK, most: int = MOST_RANGES) -> DataFrame:
    """Write the rows in ranges of ``order`` (nulls first) of about ``block`` rows: adds ``_range``, which
    ascends with the order, and ``_at``, the place of a row among all. The order-preserving exchange is
    Spark's range partitioning; it is written because a second run could sample other bounds."""
    n = min(most, max(1, -(-df.count() // block)))
    by = [F.asc_nulls_first(c) for c in order]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("_range", F.shiftright("_at", 33).cast("int")), "ranges")


def running_total(
    df: DataFrame,
    value: Column,
    out: str,
    by: Sequence[str] = (),
    major: str | None = None,
    row: str = "row",
    op: str = "sum",
    inclusive: bool = False,
    block: int = BLOCK,
    group_total: str | None = None,
) -> DataFrame:
    """Add ``out``: ``op`` of ``value`` over all earlier rows (and this one when
    ``inclusive``), and ``group_total`` over the whole ``by`` group if named.
    ``(by, major, row)`` must be unique; ``row`` may have gaps of any size.

    ``df`` is read for its keys and values, and once more if it has other columns."""
    agg, join_op = _AGG[op], _JOIN_OP[op]
    keys = [*by, *([major] if major else []), row]
    rows = ranged(df.select(*keys, value.alias("_v")), keys, block)
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_range").agg(agg("_v").alias("_t")).select(
        *by, "_range",
        agg("_t").over(before).alias("_start"),
        *([agg("_t").over(group).alias(group_total)] if group_total else []),
    )
    frame = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    near = [*by, "_range"]
    totals = (
        rows.withColumn("_local", agg("_v").over(frame))
        .join(renamed(starts, near), null_safe(near))
        .withColumn(out, join_op(F.col("_local"), F.col("_start")))
    )
    added = [out, *([group_total] if group_total else [])]
    if set(df.columns) <= set(keys):
        return totals.select(*df.columns, *added)
    return df.join(renamed(totals.select(*keys, *added), keys), null_safe(keys)).select(*df.columns, *added)


def dense_index(
    df: DataFrame, out: str, by: Sequence[str] = (), major: str | None = None, row: str = "row"
) -> DataFrame:
    """Add the 0-based position of each row in its group."""
    return running_total(df, F.lit(1).cast("bigint"), out, by, major, row)


def shuffled_position(
    df: DataFrame, hash_col: Column, out: str, by: Sequence[str], tie: str, buckets: int = 65536
) -> DataFrame:
    """Add the 0-based position of each row of a group in the order of a hex hash
    and ``tie``. Rows are counted per bucket of the hash, so that no task sorts a
    whole group."""
    hexed = df.withColumn("_h", hash_col).withColumn(
        "_bucket", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * buckets / 4294967296).cast("bigint")
    )
    local = Window.partitionBy(*by, "_bucket").orderBy("_h", tie)
    # At most ``buckets`` rows per group.
    counts = hexed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        hexed.withColumn("_r", F.row_number().over(local) - 1)
        .join(renamed(starts.select(*by, "_bucket", "_start"), [*by, "_bucket"]), null_safe([*by, "_bucket"]))
        .withColumn(out, F.col("_start") + F.col("_r"))
        .select(*df.columns, out)
    )
