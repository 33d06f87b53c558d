"""Windows over groups of any size: cut into blocks of time, with what the other blocks give carried over.

A window over a group runs in one task. Where one group may hold a third of all rows it is cut by time: the
window runs within a block, each block is reduced to one row, and a second window over these few rows carries results from
block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of(column: str, unit: str = "day") -> Column:
    """The block of a time; null times are before all others."""
    return F.coalesce(F.unix_micros(F.date_trunc(unit, column)), F.lit(-(1 << 62)))


def _over(ends: DataFrame, by: list[str], what: Column, backwards: bool) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("block") if backwards else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("carried", what.over(w))


def before(ends: DataFrame, by: list[str], what: Column) -> DataFrame:
    """``ends``, one row for each group and block, with ``carried``: ``what`` over the blocks before."""
    return _over(ends, by, what, False)


def after(ends: DataFrame, by: list[str], what: Column) -> DataFrame:
    """As ``before`` over the blocks behind, from the last one back."""
    return _over(ends, by, what, True)


def joined(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is carried into their block; adaptive skew handling splits a hot block."""
    return rows.join(carried, [*by, "block"], "left")
