"""Gapless numbers within groups that may be arbitrarily hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """The names, each behind as many ``_`` as it takes to differ from all of ``taken`` in any case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def number_within(df: DataFrame, group: str, order: Sequence[str], out: str, salts: int = 64) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps within each value of ``group``.

    A group is dealt over ``salts`` slices by a hash of ``order``, rows are numbered inside their
    slice, and each slice starts where the counts of the slices before it end. So no task needs
    more than one slice of a hot group. Rows equal in all of ``order`` are numbered in any order;
    null groups are a group of their own. Other columns stay, whatever their names; one named ``out`` is replaced.
    """
    slice_, row, g, s, start, n = fresh(df.columns, "_slice", "_row", "_g", "_s", "_start", "_n")
    sliced = df.withColumn(slice_, F.pmod(F.xxhash64(F.lit(17), *order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(group, slice_)
        .agg(F.count(F.lit(1)).alias(n))
        .select(F.col(group).alias(g), F.col(slice_).alias(s), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    )
    inside = Window.partitionBy(group, slice_).orderBy(*order)
    return (
        sliced.withColumn(row, F.row_number().over(inside))
        .join(starts, F.col(group).eqNullSafe(F.col(g)) & (F.col(slice_) == F.col(s)))
        .withColumn(out, F.col(start) + F.col(row) - 1)
        .drop(slice_, g, s, start, row)
    )
