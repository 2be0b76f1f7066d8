"""The plan table ``(plan_id, unit_id, district)`` and ways to cut it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach
from hemicycle.functions.ordered import row_index
from hemicycle.session import cut_lineage


def plan_from_column(units: DataFrame, column: str, plan_id: int = 0) -> DataFrame:
    return units.select(F.lit(plan_id).alias("plan_id"), "unit_id", F.col(column).alias("district"))


def modulo_plan(units: DataFrame, n: int, order: Sequence[str] = ("unit_id",), plan_id: int = 0) -> DataFrame:
    """Unit at position i (in the given order) goes to district ``i % n``."""
    placed = row_index(units.select("unit_id", *[o for o in order if o != "unit_id"]), (), order, "_i")
    return placed.select(F.lit(plan_id).alias("plan_id"), "unit_id", (F.col("_i") % n).alias("district"))


def filter_plans(
    plans: DataFrame, stats: DataFrame, max_dev: float | None = None,
    min_pp: float | None = None, max_cut: float | None = None,
) -> DataFrame:
    """Rows of the plans whose statistics pass every given bound."""
    good = stats
    if max_dev is not None:
        good = good.where(F.col("max_dev_pct") <= max_dev)
    if min_pp is not None:
        good = good.where(F.coalesce("pp_mean", F.lit(0.0)) >= min_pp)
    if max_cut is not None:
        good = good.where(F.col("cut_edges") <= max_cut)
    return plans.join(good.select("plan_id"), "plan_id", "left_semi")


def validity_filter(stats: DataFrame, tolerance: float) -> DataFrame:
    """Plans within the first tolerance of 1x, 1.5x, 2x and 100 % that keeps
    any plan, else all; adds the tolerance used and a fallback flag."""
    levels = [tolerance, tolerance * 1.5, tolerance * 2, 1.0]
    hits = stats.agg(*[F.count_if(F.col("max_dev_pct") <= t * 100).alias(f"h{i}") for i, t in enumerate(levels)])
    used: Column = F.lit(None).cast("double")
    for i, t in reversed(list(enumerate(levels))):
        used = F.when(F.col(f"h{i}") > 0, F.lit(float(t))).otherwise(used)
    chosen = hits.select(used.alias("tolerance_used"))
    inside = F.col("tolerance_used").isNull() | (F.col("max_dev_pct") <= F.col("tolerance_used") * 100)
    fallback = F.col("tolerance_used").isNull() | (F.col("tolerance_used") != tolerance)
    return attach(stats, chosen).where(inside).withColumn("fallback", fallback)


#: bits of a draw number, and bits that one histogram tells apart
_DRAW, _DIGIT = 60, 12


def sample_plans(plans: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of n plans drawn without replacement (all when n is larger).

    The plans with the smallest md5 digests of ``seed:plan_id`` are drawn, so
    the draw does not depend on layout. Histograms of the digests, 4096 counts
    each, find the largest digest drawn; no task sorts the plans.
    """
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("plan_id").cast("string"))), 1, _DRAW // 4)
    ids = cut_lineage(plans.select("plan_id").where("plan_id IS NOT NULL").distinct().withColumn("_h", F.conv(digest, 16, 10).cast("long")))
    prefix, need, width = 0, n, _DRAW
    while width:
        width -= _DIGIT
        inside = ids.where(F.shiftright("_h", width + _DIGIT) == prefix)
        counts = inside.groupBy(F.shiftright("_h", width).bitwiseAND((1 << _DIGIT) - 1).alias("d")).agg(F.count("*").alias("c"))
        for r in sorted(counts.collect()):  # at most 2 ** _DIGIT rows
            if r.c >= need:
                prefix = prefix << _DIGIT | r.d
                break
            need -= r.c
        else:  # fewer plans than asked for
            return plans.join(ids.select("plan_id"), "plan_id", "left_semi")
        if r.c == need:
            drawn = ids.where(F.col("_h") < (prefix + 1) << width)
            break
    else:  # equal digests to the last bit
        ties = ids.where(F.col("_h") == prefix).orderBy("plan_id").limit(need)
        drawn = ids.where(F.col("_h") < prefix).unionByName(ties)
    return plans.join(drawn.select("plan_id"), "plan_id", "left_semi")


def evenly_spaced_plans(plans: DataFrame, n: int) -> DataFrame:
    """Plans at n evenly spaced positions from the first to the last."""
    ids = row_index(plans.select("plan_id").distinct(), (), ["plan_id"], "_i")
    ids = attach(ids, ids.agg(F.count(F.lit(1)).alias("_size")))
    step = (F.col("_size") - 1) / max(n - 1, 1)
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(j == n - 1, F.col("_size") - 1).otherwise(F.floor(j * step)) if n > 1 else j)
    wanted = (F.col("_size") <= n) | F.array_contains(spots, F.col("_i"))
    return plans.join(ids.where(wanted).select("plan_id"), "plan_id", "left_semi")


def propagate_assignment(plans: DataFrame, units: DataFrame, coarse: str) -> DataFrame:
    """A plan of coarse units carried to their fine units; fine units whose
    coarse unit has no district are left out."""
    placed = plans.withColumnRenamed("unit_id", coarse)
    return units.select("unit_id", coarse).join(placed, coarse).select("plan_id", "unit_id", "district")
