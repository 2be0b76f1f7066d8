"""Shape, balance and position of the districts of many plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hemicycle.functions.frames import attach, rnd, small_side
from hemicycle.operators.geometry import polsby_popper
from hemicycle.operators.graph import cut_edges, edge_sides
from hemicycle.operators.integrity import max_deviation, split_measures


def dissolve(plans: DataFrame, measures: DataFrame, borders: DataFrame) -> DataFrame:
    """Area and perimeter of the union of each district's units.

    Borders between two units of one district vanish from both, so per plan
    only the unit and border tables are read, never the vertices. Exact when
    neighbours share identical vertices (no gaps or overlaps).
    """
    inner = edge_sides(borders, plans).where("src_district = dst_district").groupBy(
        "plan_id", F.col("src_district").alias("district")
    ).agg(F.sum("border").alias("_inner"))
    outer = plans.join(small_side(measures), "unit_id").groupBy("plan_id", "district").agg(
        F.sum("area").alias("area"), F.sum("perimeter").alias("_sum"), F.count(F.lit(1)).alias("n_units")
    )
    out = attach(outer, inner, ["plan_id", "district"])
    return out.withColumn("perimeter", F.col("_sum") - 2 * F.coalesce("_inner", F.lit(0.0))).drop("_sum", "_inner")


def plan_compactness(districts: DataFrame) -> DataFrame:
    """Mean Polsby-Popper of the districts of each plan."""
    pp = polsby_popper(F.col("area"), F.col("perimeter"))
    return districts.groupBy("plan_id").agg(F.avg(pp).alias("pp_mean"))


def plan_summary(plans: DataFrame, units: DataFrame, measures: DataFrame, borders: DataFrame, edges: DataFrame) -> DataFrame:
    """Per district: units, population, area, compactness, deviation, cuts."""
    shape = dissolve(plans, measures, borders)
    pop = plans.join(small_side(units.select("unit_id", "population")), "unit_id").groupBy("plan_id", "district").agg(
        F.sum("population").alias("population")
    )
    sides = edge_sides(edges.select("src", "dst"), plans).where("src_district <> dst_district")
    cuts = sides.select("plan_id", F.explode(F.array("src_district", "dst_district")).alias("district")).groupBy(
        "plan_id", "district"
    ).agg(F.count(F.lit(1)).alias("cut_edges"))
    keys = ["plan_id", "district"]
    ideal = attach(pop, pop.groupBy("plan_id").agg(F.avg("population").alias("ideal")), ["plan_id"])
    gap = (F.col("population") - F.col("ideal")) / F.col("ideal")
    return attach(shape.join(ideal, keys), cuts, keys).select(
        *keys, "n_units", "population", (F.col("area") / 1e6).alias("area_km2"),
        polsby_popper(F.col("area"), F.col("perimeter")).alias("polsby_popper"),
        (gap * 100).alias("deviation_pct"), (F.abs(gap) <= 0.05).alias("within_5pct"),
        F.coalesce("cut_edges", F.lit(0)).alias("cut_edges"),
    )


def position_plans(
    plans: DataFrame, units: DataFrame, measures: DataFrame, borders: DataFrame, edges: DataFrame, unit_col: str
) -> DataFrame:
    """One row per plan with the metrics used to place it in an ensemble."""
    dev = max_deviation(plans, units).select(
        "plan_id", rnd("max_dev_pct", 4).alias("max_dev_pct"), "n_districts", "total_population"
    )
    pp = plan_compactness(dissolve(plans, measures, borders)).select("plan_id", rnd("pp_mean", 4).alias("pp_mean"))
    splits = split_measures(plans, units, [unit_col]).select(
        "plan_id", "split_units", rnd("split_severity", 4).alias("split_severity"), "affected_share"
    )
    out = dev
    for part in (pp, cut_edges(edges, plans), splits):
        out = attach(out, part, ["plan_id"])
    return out.withColumn("cut_edges", F.coalesce("cut_edges", F.lit(0)))
