"""Balance, splits and validity of plans over the long plan table.

Every function works on all plans at once; a single plan is an ensemble of
one. Sums are combined on the map side before each shuffle, so a plan or an
administrative unit with very many rows does not load one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach, group_window, ratio, rnd, small_side
from hemicycle.functions.ordered import exact_quantiles
from hemicycle.functions.rules import SMALL_FRAGMENT_SHARE, is_split

PLAN = ["plan_id"]


def population_balance(units: DataFrame, label: str | None = None) -> DataFrame:
    """Deviation of each district (column ``district``) from the mean one."""
    extra = [F.min(label).alias("label")] if label else []
    pop = units.groupBy("district").agg(F.sum("population").alias("population"), *extra)
    w = group_window(())
    ideal = F.avg("population").over(w)
    gap = (F.col("population") - F.col("ideal")) / F.col("ideal")
    out = pop.withColumn("ideal", ideal).withColumns(
        {
            "deviation_abs": F.col("population") - F.col("ideal"),
            "deviation_pct": gap * 100,
            "within_5pct": F.abs(gap) <= 0.05,
        }
    )
    return out.withColumn("max_deviation_pct", F.max(F.abs("deviation_pct")).over(w))


def ideal_population(units: DataFrame, n: int) -> DataFrame:
    return units.agg((F.sum("population") / n).alias("ideal"))


def max_deviation(plans: DataFrame, population: DataFrame, n_districts: int | None = None) -> DataFrame:
    """Largest deviation in percent per plan.

    The ideal is total / ``n_districts``, or the mean over the districts
    present when no number is given.
    """
    pop = (
        plans.join(small_side(population.select("unit_id", "population")), "unit_id", "left")
        .groupBy("plan_id", "district")
        .agg(F.sum(F.coalesce("population", F.lit(0))).alias("_p"))
    )
    total = F.sum("_p")
    ideal = total / n_districts if n_districts else F.avg("_p")
    spread = pop.groupBy("plan_id").agg(
        ideal.alias("ideal"), F.max("_p").alias("_hi"), F.min("_p").alias("_lo"),
        F.count(F.lit(1)).alias("n_districts"), total.alias("total_population"),
    )
    worst = F.greatest(F.col("_hi") - F.col("ideal"), F.col("ideal") - F.col("_lo"))
    return spread.withColumn("max_dev_pct", ratio(worst, F.col("ideal")) * 100).drop("_hi", "_lo")


def fragments(plans: DataFrame, units: DataFrame, unit_cols: Sequence[str]) -> DataFrame:
    """Population of each (plan, administrative unit, district).

    ``unit_cols`` are evaluated as levels in one pass: (plan_id, level, unit,
    district, population, name).
    """
    levels = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("unit")) for c in unit_cols])
    wide = units.select("unit_id", F.coalesce("population", F.lit(0)).alias("population"), F.inline(levels))
    return (
        plans.join(small_side(wide), "unit_id")
        .groupBy("plan_id", "level", "unit", "district")
        .agg(F.sum("population").alias("population"))
    )


def unit_splits(parts: DataFrame) -> DataFrame:
    """One row per (plan, level, unit) with its population and districts."""
    return parts.groupBy("plan_id", "level", "unit").agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.sum("population").alias("population"),
        F.sort_array(F.collect_list("district")).alias("districts"),
    )


def small_fragments(parts: DataFrame, min_share: float = SMALL_FRAGMENT_SHARE) -> DataFrame:
    """Fragments of split units below ``min_share`` of their unit."""
    w = group_window(["plan_id", "level", "unit"])
    total, n = F.sum("population").over(w), F.count(F.lit(1)).over(w)
    marked = parts.withColumn("_n", n).withColumn("share", ratio(F.col("population"), total, 0.0))
    return marked.where(is_split(F.col("_n")) & (F.col("share") < min_share)).drop("_n")


def split_measures(
    plans: DataFrame, units: DataFrame, unit_cols: Sequence[str], small: float = SMALL_FRAGMENT_SHARE
) -> DataFrame:
    """Split units, severity, small fragments and affected population.

    One row per (plan, level). ``affected_share`` is a fraction.
    """
    w = group_window(["plan_id", "level", "unit"])  # at most one row per district
    total, n = F.sum("population").over(w), F.count(F.lit(1)).over(w)
    parts = fragments(plans, units, unit_cols).withColumns(
        {"_unit": total, "_n": n, "_first": F.row_number().over(w.orderBy("district")) == 1}
    )
    split = is_split(F.col("_n"))
    tiny = split & (ratio(F.col("population"), F.col("_unit"), 0.0) < small)
    people = F.sum("population")
    weighted = F.sum(F.when(F.col("_first"), (F.col("_n") - 1) * F.col("_unit")))
    out = parts.groupBy("plan_id", "level").agg(
        F.count_if(F.col("_first") & split).alias("split_units"),
        ratio(weighted, people, 0.0).alias("split_severity"),
        F.count_if(tiny).alias("small_fragments"),
        rnd(ratio(F.sum(F.when(split, F.col("population")).otherwise(0)), people, 0.0), 4).alias("affected_share"),
    )
    counts = units.agg(*[F.count_distinct(c).alias(c) for c in unit_cols]).unpivot([], list(unit_cols), "level", "n_units")
    return out.join(counts, "level").withColumn(
        "split_share", rnd(ratio(F.col("split_units"), F.col("n_units"), 0.0), 4)
    )


def split_severity_uniform(plans: DataFrame, units: DataFrame, unit_col: str) -> DataFrame:
    """Severity when no population is known: every unit weighs the same."""
    by_unit = (
        plans.join(small_side(units.select("unit_id", unit_col)), "unit_id").select("plan_id", unit_col, "district").distinct()
        .groupBy("plan_id", unit_col).agg(F.count(F.lit(1)).alias("_n"))
    )
    return by_unit.groupBy("plan_id").agg((F.sum(F.col("_n") - 1) / F.count(F.lit(1))).alias("split_severity"))


def split_unit_summary(plans: DataFrame, units: DataFrame, unit_col: str, name: str | None = None) -> DataFrame:
    """Each split unit with its districts, population share and severity."""
    by_unit = unit_splits(fragments(plans, units, [unit_col]))
    by_unit = attach(by_unit, by_unit.groupBy("plan_id").agg(F.sum("population").alias("_total")), PLAN)
    share = ratio(F.col("population"), F.col("_total"), 0.0)
    out = by_unit.where(is_split(F.col("n_fragments"))).select(
        "plan_id", "unit", "n_fragments", "districts", "population",
        rnd(share, 4).alias("population_share"),
        rnd((F.col("n_fragments") - 1) * share, 6).alias("split_severity"),
    )
    if name is None:
        return out
    names = units.groupBy(F.col(unit_col).cast("string").alias("unit")).agg(F.min(name).alias("name"))
    return out.join(names, "unit", "left")


def plan_split_metrics(plans: DataFrame, units: DataFrame, unit_col: str, top: int = 5) -> DataFrame:
    """Split measures per plan and its most populated split units."""
    measures = split_measures(plans, units, [unit_col]).withColumn("split_severity", rnd("split_severity", 4))
    order = group_window(PLAN).orderBy(F.col("population").desc(), "unit")
    ranked = split_unit_summary(plans, units, unit_col).withColumn("_r", F.row_number().over(order)).where(f"_r <= {int(top)}")
    best = ranked.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("_r", "unit"))).alias("_u"))
    best = best.select("plan_id", F.transform("_u", lambda u: u["unit"]).alias("most_split"))
    out = attach(measures.drop("level", "n_units"), best, PLAN)
    return out.withColumn("most_split", F.coalesce("most_split", F.array().cast("array<string>")))


def multi_level_split_metrics(plans: DataFrame, units: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Splits per administrative level, with people affected and percent."""
    total = units.agg(F.sum("population").cast("double").alias("total_population"))
    measures = attach(split_measures(plans, units, levels), total)
    return measures.select(
        "plan_id", "level", "split_units", "n_units", "split_share",
        rnd(F.col("affected_share") * F.col("total_population"), 4).alias("affected_population"),
        "total_population",
        rnd(F.col("affected_share") * 100, 4).alias("affected_pct"),
    )


def penalised_score(base: DataFrame, severity: DataFrame, penalties: dict[str, float]) -> DataFrame:
    """Base score minus penalty x severity over the soft levels.

    ``severity`` is (plan_id, level, split_severity).
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in penalties.items() for x in p]), F.col("level")), F.lit(0.0))
    cost = severity.groupBy("plan_id").agg(F.sum(weight * F.col("split_severity")).alias("_cost"))
    return attach(base, cost, PLAN).withColumn(
        "score", F.col("base_score") - F.coalesce("_cost", F.lit(0.0))
    ).drop("_cost")


def ensemble_score(stats: DataFrame, penalty: float = 0.0) -> DataFrame:
    """Score of each plan: low deviation and cuts, high compactness.

    ``stats`` has max_dev_pct, cut_edges, pp_mean and split_severity; missing
    compactness and severity take the ensemble median.
    """
    tiny = 1e-10
    medians = None
    for col in ("pp_mean", "split_severity"):
        m = exact_quantiles(stats, (), col, {f"_med_{col}": 0.5})
        medians = m if medians is None else attach(medians, m)
    filled = attach(stats, medians).withColumns(
        {
            "_pp": F.coalesce("pp_mean", "_med_pp_mean"),
            "_sev": F.coalesce("split_severity", "_med_split_severity", F.lit(0.0)),
        }
    )
    spans = filled.agg(
        F.max("max_dev_pct").alias("_dev_max"), F.max("cut_edges").alias("_cut_max"),
        F.max("_pp").alias("_pp_max"), F.min("_pp").alias("_pp_min"), F.max("_sev").alias("_sev_max"),
    )
    pp = (F.col("_pp") - F.col("_pp_min")) / (F.col("_pp_max") - F.col("_pp_min") + tiny)
    score = (
        -F.col("max_dev_pct") / (F.col("_dev_max") + tiny)
        + F.coalesce(pp, F.lit(0.0))
        - F.col("cut_edges") / (F.col("_cut_max") + tiny)
        - penalty * F.col("_sev") / (F.col("_sev_max") + tiny)
    )
    return attach(filled, spans).withColumn("score", score).select(*stats.columns, "score")


def reference_plans(scored: DataFrame) -> DataFrame:
    """Best and worst scored plan, ties to the smaller id."""
    return scored.agg(
        F.max_by("plan_id", F.struct("score", -F.col("plan_id"))).alias("reference_plan"),
        F.min_by("plan_id", F.struct("score", "plan_id")).alias("extreme_plan"),
    )


def reference_plan_detail(plan: DataFrame, units: DataFrame, n_districts: int) -> DataFrame:
    """Population, units, communes and deviation of each district of a plan."""
    placed = plan.where("district IS NOT NULL").join(units, "unit_id")
    total = units.agg((F.sum("population") / n_districts).alias("_ideal"))
    out = placed.groupBy("plan_id", "district").agg(
        F.sum("population").alias("population"),
        F.count(F.lit(1)).alias("n_units"),
        F.count_distinct("commune").alias("n_communes"),
    )
    gap = (F.col("population") - F.col("_ideal")) / F.col("_ideal") * 100
    return attach(out, total).withColumn("deviation_pct", rnd(gap, 2)).drop("_ideal")


def preserve_violations(
    plans: DataFrame, units: DataFrame, unit_cols: Sequence[str], tolerance: float, contiguous: DataFrame
) -> DataFrame:
    """Audit of the hard rules per plan: whole units, contiguity, population.

    ``contiguous`` is the per-district result of the contiguity operator.
    """
    splits = split_measures(plans, units, unit_cols).groupBy("plan_id").agg(
        F.sum("split_units").alias("split_units")
    )
    deviation = max_deviation(plans, units).select("plan_id", "max_dev_pct")
    joined = contiguous.groupBy("plan_id").agg(F.bool_and("contiguous").alias("contiguous"))
    out = attach(attach(splits, deviation, PLAN), joined, PLAN)
    return out.select(
        "plan_id", (F.col("split_units") == 0).alias("units_whole"), "contiguous",
        (F.col("max_dev_pct") <= tolerance * 100).alias("population_ok"),
    )


# fixed value: reason of an infeasible request
INDIVISIBLE = "indivisible_unit_exceeds_population_bound"


def population_feasibility(units: DataFrame, n_districts: int, tolerance: float, unit_col: str = "unit_id") -> DataFrame:
    """Whether the largest indivisible unit fits into one district."""
    if n_districts < 1:
        raise ValueError("n_districts must be at least 1")
    whole = units.groupBy(F.col(unit_col).alias("unit")).agg(F.sum("population").alias("population"))
    largest = F.min(F.struct((-F.col("population")).alias("_less"), "unit", "population"))  # ties to the smaller id, of any type
    out = whole.agg(F.sum("population").alias("total_population"), largest.alias("_top"))
    total = F.when(F.col("total_population") > 0, F.col("total_population")).otherwise(
        F.raise_error(F.lit("total population must be positive"))
    )
    ideal = total / n_districts
    needed = F.greatest(F.lit(0.0), F.col("_top.population") / ideal - 1)
    return out.select(
        "total_population", ideal.alias("ideal"), F.col("_top.unit").alias("largest_unit"),
        F.col("_top.population").alias("largest_population"), needed.alias("required_tolerance"),
        (needed <= tolerance).alias("feasible"), F.lit(float(tolerance)).alias("requested_tolerance"),
        F.when(needed > tolerance, INDIVISIBLE).alias("reason"),
    )


def effective_district_count(n_units: Column, asked: int) -> Column:
    """Small regions get at most a quarter of their units as districts."""
    most = F.greatest(F.lit(2), F.floor(n_units / 4))
    return F.when(n_units < 80, F.least(F.lit(asked), most)).otherwise(F.lit(asked)).cast("int")
