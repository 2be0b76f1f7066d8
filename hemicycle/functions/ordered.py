"""Running totals and exact quantiles without a one-task sort.

A plain ordered window sends a whole group to one task. Here rows are range
partitioned on (group, order), each slice is scanned on its own and the
totals of the earlier slices (one row per slice) are added. A group that holds
a third of all rows is thus spread over a third of all slices.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from hemicycle.functions.frames import attach
from hemicycle.session import cut_lineage

_FOLD = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}


def running(
    df: DataFrame,
    keys: Iterable[str],
    order: Iterable[Column | str],
    totals: dict[str, tuple[str, str]],
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``min``/``max`` per group in a total order.

    ``totals`` maps output name to (function, column). ``exclusive`` leaves
    the current row out. Slices are stored by a checkpoint, so the slice
    number of a row never changes when a lost task is run again.
    """
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    slice_totals = sliced.groupBy(*keys, "_slice").agg(
        *[getattr(F, fn)(col).alias(f"_total_{out}") for out, (fn, col) in totals.items()]
    )
    before = (
        Window.partitionBy(*keys or [F.lit(0)])
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = slice_totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_slice").alias("_key__slice"),
        *[
            getattr(F, fn)(f"_total_{out}").over(before).alias(f"_offset_{out}")
            for out, (fn, _) in totals.items()
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    same = F.col("_slice") == F.col("_key__slice")
    for k in keys:  # a null key is a group of its own, as in a window
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return sliced.join(offsets, same).select(
        *df.columns,
        *[
            _FOLD[fn](F.col(f"_offset_{out}"), getattr(F, fn)(col).over(inside)).alias(out)
            for out, (fn, col) in totals.items()
        ],
    )


def row_index(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str], name: str) -> DataFrame:
    """0-based position of each row in its group; ``order`` must be total."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, keys, order, {name: ("sum", "_one")}, exclusive=True).drop("_one")


def exact_quantiles(
    df: DataFrame, keys: Iterable[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, nulls ignored.

    Equal values are counted before the shuffle, then the two neighbouring
    ranks of every probability are picked from running counts.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(counts, keys, ["_v"], {"_upto": ("sum", "_n")})
    sizes = ranked.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = attach(ranked, sizes, keys)
    first_rank, end_rank = F.col("_upto") - F.col("_n"), F.col("_upto")
    picks = []
    for i, p in enumerate(probs.values()):
        low = F.floor(F.lit(p) * (F.col("_size") - 1))
        for side, rank in (("lo", low), ("hi", F.least(low + 1, F.col("_size") - 1))):
            here = (first_rank <= rank) & (rank < end_rank)
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys).agg(*picks, F.max("_size").alias("_size"))
    out = []
    for i, (name, p) in enumerate(probs.items()):
        spot = F.lit(p) * (F.col("_size") - 1)
        step = (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot))
        out.append((F.col(f"_lo{i}") + step).alias(name))
    return found.select(*keys, *out)
