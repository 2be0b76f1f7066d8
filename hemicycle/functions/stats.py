"""Distribution summaries: moments from one aggregation, exact quantiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach, group_window, ratio, rnd
from hemicycle.functions.ordered import exact_quantiles, running

QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def clean(value: Column | str) -> Column:
    """NaN becomes null, so that aggregates and quantiles skip it."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value.cast("double")), value.cast("double"))


def dist_stats(df: DataFrame, value: str, keys: Iterable[str] = ()) -> DataFrame:
    """Mean, sd, quantiles and normal 95 % interval per group, 6 digits."""
    keys = list(keys)
    rows = df.select(*keys, clean(value).alias("_x")).where("_x IS NOT NULL")
    mean, n = F.avg("_x"), F.count("_x")
    sd = F.coalesce(F.stddev_samp("_x"), F.lit(0.0))
    half = 1.96 * sd / F.sqrt(n)
    moments = rows.groupBy(*keys).agg(
        rnd(mean, 6).alias("mean"),
        rnd(sd, 6).alias("std"),
        rnd(mean - half, 6).alias("ci95_low"),
        rnd(mean + half, 6).alias("ci95_high"),
        n.alias("n"),
    )
    marks = exact_quantiles(rows, keys, "_x", QUANTILES)
    marks = marks.select(*keys, *[rnd(q, 6).alias(q) for q in QUANTILES])
    return attach(moments, marks, keys)


def to_long(df: DataFrame, ids: Iterable[str], metrics: Iterable[str]) -> DataFrame:
    """(ids, metric, value) with NaN as null."""
    metrics = list(metrics)
    plain = df.select(*ids, *[clean(m).alias(m) for m in metrics])
    return plain.unpivot(list(ids), metrics, "metric", "value")


def ecdf(df: DataFrame, value: str, keys: Iterable[str] = ()) -> DataFrame:
    """Share of rows at or below each distinct value."""
    keys = list(keys)
    counts = (
        df.select(*keys, clean(value).alias("value")).where("value IS NOT NULL")
        .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(counts, keys, ["value"], {"_upto": ("sum", "_n")})
    ranked = attach(ranked, ranked.groupBy(*keys).agg(F.sum("_n").alias("_size")), keys)
    return ranked.select(*keys, "value", F.col("_n").alias("n"), (F.col("_upto") / F.col("_size")).alias("share"))


def share_at_or_below(df: DataFrame, value: str, observed: float | Column, keys: Iterable[str] = ()) -> DataFrame:
    x = clean(value)
    return df.groupBy(*keys).agg((F.count_if(x <= observed) / F.count(x)).alias("share_at_or_below"))


def histogram(df: DataFrame, value: str, bins: int, keys: Iterable[str] = ()) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value.

    The last bin includes its upper edge; empty bins have no row. A constant
    group spans one unit around its value.
    """
    keys = list(keys)
    rows = df.select(*keys, clean(value).alias("_x")).where("_x IS NOT NULL")
    span = rows.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    span = span.select(
        *keys,
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("low"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("high"),
    )
    place = F.floor((F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    counted = attach(rows, span, keys).groupBy(*keys, "low", "high", F.least(place, F.lit(bins - 1)).alias("bin"))
    return counted.agg(F.count(F.lit(1)).alias("n"))


def radar(df: DataFrame, id_col: str, directions: dict[str, str]) -> DataFrame:
    """0-1 scores per metric over all rows, 1 best; constant columns give 0.5."""
    long = to_long(df, [id_col], directions)
    span = long.groupBy("metric").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    scaled = ratio(F.col("value") - F.col("_a"), F.col("_b") - F.col("_a"), 0.5)
    lowest_first = F.col("metric").isin([m for m, d in directions.items() if d == "min"])
    score = F.when(F.col("_a") == F.col("_b"), 0.5).when(lowest_first, 1 - scaled).otherwise(scaled)
    return attach(long, span, ["metric"]).select(id_col, "metric", score.alias("score"))


def average_rank(value: Column, keys: Iterable[str], descending: bool = False) -> Column:
    """Rank with ties sharing their mean, over a domain-bounded group."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    first = F.rank().over(group_window(keys).orderBy(order))
    same = group_window(keys).partitionBy(*keys, value)
    return first + (F.count(F.lit(1)).over(same) - 1) / 2
