"""Token array expressions. All of them work inside one row and never shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference == 0, F.size(a)).otherwise(first_difference - 1).cast("int")


def common_prefix_len(seqs: Column) -> Column:
    """Number of leading elements all arrays share; the first one is compared with each."""
    return F.array_min(F.transform(seqs, lambda s: shared_prefix(seqs[0], s)))


def common_suffix_len(seqs: Column) -> Column:
    return common_prefix_len(F.transform(seqs, lambda s: F.reverse(s)))


def crop_left(ids: Column, max_len: int) -> Column:
    """Keep the last ``max_len`` elements."""
    return F.when(F.size(ids) > max_len, F.slice(ids, -max_len, max_len)).otherwise(ids)


def cropped_index(index: Column, ids: Column, max_len: int) -> Column:
    """Where ``index`` moves when ``ids`` is cropped from the left. Below zero
    means the crop cut into the span."""
    return index - F.greatest(F.size(ids) - max_len, F.lit(0))


def pad_right(seqs: Column, pad: int) -> Column:
    """Pad every array of the row to the longest one."""
    longest = F.array_max(F.transform(seqs, lambda s: F.size(s)))
    return F.transform(
        seqs, lambda s: F.concat(s, F.array_repeat(F.lit(pad), (longest - F.size(s)).cast("int")))
    )


def inputs_of(ids: Column) -> Column:
    """All elements but the last."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def targets_of(ids: Column) -> Column:
    """All elements but the first: the next-token targets of ``inputs_of``."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


