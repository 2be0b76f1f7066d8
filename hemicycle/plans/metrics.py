"""Electoral metrics of every plan of an ensemble in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hemicycle.functions.frames import attach, ensure, ratio, rnd, small_side
from hemicycle.functions.rules import threshold_columns
from hemicycle.functions.stats import dist_stats, to_long
from hemicycle.operators import indices, seats
from hemicycle.session import cut_lineage


def assign_votes(votes: DataFrame, plans: DataFrame) -> DataFrame:
    """Votes by (plan, district, party); units without a district drop out.

    Votes are summed per (unit, party) first, so that repeated vote rows do
    not multiply with the number of plans.
    """
    per_unit = small_side(seats.sum_votes(votes, ("unit_id",)))
    return (
        plans.where("district IS NOT NULL").join(per_unit, "unit_id")
        .groupBy("plan_id", "district", "party")
        .agg(F.sum("votes").alias("votes"))
    )


def unmatched_votes(votes: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows and votes whose unit is in no plan."""
    lost = votes.join(plans.select("unit_id").distinct(), "unit_id", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"))


def district_population(plans: DataFrame, population: DataFrame) -> DataFrame:
    """Population by (plan, district); unknown units count 0."""
    return (
        plans.join(small_side(population.select("unit_id", "population")), "unit_id", "left")
        .groupBy("plan_id", "district")
        .agg(F.coalesce(F.sum("population"), F.lit(0)).alias("population"))
    )


def _results(cast, pop, magnitudes, pacts, threshold, strict, bounds):
    """Seats of every (plan, district, party), and the district table."""
    if magnitudes is None:
        table = seats.magnitudes_dhondt(pop, ("plan_id",), **bounds)
    else:
        table = pop.join(magnitudes.select("district", "magnitude"), "district", "left")
        known = F.col("magnitude").isNotNull()
        fixed = (
            ensure(known, "a district of the plan has no magnitude", F.col("magnitude"))
            if strict else F.coalesce("magnitude", F.lit(0))
        )
        table = table.withColumn("magnitude", fixed)
    keys = ("plan_id", "district")
    if pacts is None:
        result = seats.run_plan(cast, table, keys, threshold)
    else:
        result = seats.run_plan_two_level(seats.attach_pact(cast, pacts), table, keys, threshold)
    return result, table


def _labels(df: DataFrame, magnitudes, pacts) -> DataFrame:
    return df.withColumn("allocation_mode", F.lit("one_level" if pacts is None else "two_level")).withColumn(
        "magnitude_mode", F.lit("computed" if magnitudes is None else "fixed")
    )


def plan_electoral_metrics(
    plans: DataFrame,
    votes: DataFrame,
    population: DataFrame,
    magnitudes: DataFrame | None = None,
    pacts: DataFrame | None = None,
    threshold: float = 0.0,
    **bounds: int,
) -> DataFrame:
    """Proportionality, seats and malapportionment of each plan."""
    cast, pop = assign_votes(votes, plans), district_population(plans, population)
    return _metrics(cast, pop, magnitudes, pacts, threshold, bounds)


def _metrics(cast, pop, magnitudes, pacts, threshold, bounds) -> DataFrame:
    result, table = _results(cast, pop, magnitudes, pacts, threshold, True, bounds)
    shares = seats.national_shares(result, ("plan_id",))
    gap = F.abs(F.col("seat_share") * 100 - F.col("vote_share") * 100)
    party = shares.groupBy("plan_id").agg(
        F.max("seats").alias("largest_party_seats"),
        F.count_if(F.col("seats") > 0).alias("parties_with_seats"),
        rnd(F.max(rnd(gap, 4)), 4).alias("seat_bonus_max"),
    )
    weight = indices.relative_vote_weight(table, ("plan_id",))
    pps, rel = F.col("persons_per_seat"), F.col("relative_weight")
    mal = weight.groupBy("plan_id").agg(
        rnd(F.max(pps), 0).alias("persons_per_seat_max"),
        rnd(F.min(pps), 0).alias("persons_per_seat_min"),
        rnd(ratio(F.max(pps), F.min(pps)), 4).alias("persons_per_seat_ratio"),
        rnd(F.max(rel), 4).alias("relative_weight_max"),
        rnd(F.min(rel), 4).alias("relative_weight_min"),
    )
    out = attach(indices.disproportionality(shares, ("plan_id",)), party, ["plan_id"])
    return _labels(attach(out, mal, ["plan_id"]), magnitudes, pacts)


def electoral_ensemble(
    plans: DataFrame,
    votes: DataFrame,
    population: DataFrame,
    magnitudes: DataFrame | None = None,
    pacts: DataFrame | None = None,
    threshold: float = 0.0,
    parties: Sequence[str] = (),
    **bounds: int,
) -> DataFrame:
    """Indices per plan, with one seat-bonus column per named party.

    A district without a fixed magnitude gets no seats and is skipped.
    """
    cast, pop = assign_votes(votes, plans), district_population(plans, population)
    result, _ = _results(cast, pop, magnitudes, pacts, threshold, False, bounds)
    shares = seats.national_shares(result, ("plan_id",))
    bonus = rnd(F.col("seat_share") * 100 - F.col("vote_share") * 100, 4)
    party = shares.groupBy("plan_id").agg(
        F.count_if(F.col("seats") > 0).alias("parties_with_seats"),
        *[F.max(F.when(F.col("party") == p, bonus)).alias(f"seat_bonus_{p}") for p in parties],
    )
    out = attach(indices.disproportionality(shares, ("plan_id",)), party, ["plan_id"])
    return _labels(out, magnitudes, pacts)


def ensemble_seat_bonus(results: DataFrame) -> DataFrame:
    """Seat bonus by (plan, party) in long form, for any number of parties."""
    return indices.seat_bonus(seats.national_shares(results, ("plan_id",))).select("plan_id", "party", "seat_bonus")


def ensemble_summary(stats: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Distribution of each metric over the plans, one row per metric."""
    return dist_stats(to_long(stats, [], metrics), "value", ["metric"])


def ensemble_threshold(magnitudes: DataFrame) -> DataFrame:
    """Distribution over plans of the upper threshold of each district."""
    upper = threshold_columns(F.col("magnitude"))["t_upper"]
    return dist_stats(magnitudes.withColumn("t_upper", upper), "t_upper", ["district"])


def mode_matrix(
    plan: DataFrame, votes: DataFrame, population: DataFrame, magnitudes: DataFrame, pacts: DataFrame, **bounds: int
) -> DataFrame:
    """Metrics of one plan under fixed/computed seats and one/two levels."""
    cast, pop = cut_lineage(assign_votes(votes, plan)), cut_lineage(district_population(plan, population))
    out = None
    for fixed in (magnitudes, None):
        for level in (None, pacts):
            part = _metrics(cast, pop, fixed, level, 0.0, bounds)
            out = part if out is None else out.unionByName(part)
    return out


def mode_deltas(matrix: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Fixed minus computed, per metric and allocation mode."""
    long = matrix.select("allocation_mode", "magnitude_mode", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = long.unpivot(["allocation_mode", "magnitude_mode"], list(metrics), "metric", "value")
    fixed, computed = (
        F.max(F.when(F.col("magnitude_mode") == mode, F.col("value"))) for mode in ("fixed", "computed")
    )
    return long.groupBy("allocation_mode", "metric").agg(
        fixed.alias("fixed"), computed.alias("computed"), rnd(fixed - computed, 4).alias("delta")
    )
