"""Small building blocks used by most operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from hemicycle.session import cut_lineage

Keys = Iterable[str]

#: rows up to which a side of narrow columns is sent to every executor
BROADCAST_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose next join is by a shuffle of both sides.

    Spark takes the size of a table from its file and does not see what an
    ``explode`` adds, so it would collect a plan or vertex table of any length
    on the driver to broadcast it.
    """
    return df.hint("merge")


def sized(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored side of a join: broadcast if it has at most ``limit`` rows, else
    joined by a shuffle; the other side is never broadcast."""
    return F.broadcast(stored) if stored.count() <= limit else shuffled(stored)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` stored once, and broadcast if its counted rows stay below ``limit``.

    Keeps a long plan table from being shuffled to meet a table of units. The
    check needs the real size, because Spark's estimate of an aggregated or
    joined side is far too large. A larger side is joined by a shuffle.
    """
    return sized(cut_lineage(df), limit)


def group_window(keys: Keys) -> WindowSpec:
    """Window over a group whose size the domain bounds (parties, districts)."""
    keys = list(keys)
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def attach(df: DataFrame, summary: DataFrame, keys: Keys = ()) -> DataFrame:
    """Add per-group summary columns to every row.

    With keys this is a left join whose strategy Spark picks by size. Without
    keys the one-row summary travels as a scalar subquery, so the big side is
    neither shuffled nor cross-joined.
    """
    keys = list(keys)
    if keys:
        return df.join(summary, keys, "left")
    row = summary.select(F.struct(*summary.columns).alias("s")).scalar()
    fields = [F.col("_summary").getField(c).alias(c) for c in summary.columns]
    return df.withColumn("_summary", row).select(*df.columns, *fields)


def rnd(value: Column | str, digits: int) -> Column:
    """Round half to even in decimal, as numpy does; Python's ``round`` looks at the binary value instead."""
    return F.bround(F.col(value) if isinstance(value, str) else value, digits)


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """``top / bottom`` as double, ``empty`` where the bottom is 0 or null."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(empty).cast("double"))


def ensure(condition: Column, message: str, value: Column) -> Column:
    """``value``, or a failed job where ``condition`` does not hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
