"""Disproportionality and malapportionment indices, keyed by any columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hemicycle.functions.frames import attach, ensure, group_window, ratio, rnd
from hemicycle.operators.seats import magnitudes_dhondt

# fixed values: published malapportionment figures of other chambers
LITERATURE = [
    ("Chile_legal_2021", 0.137, 0.108, 5.33, 0.44),
    ("USA_House_2023", 0.003, 0.003, 1.09, 0.04),
    ("Argentina_2019", 0.241, 0.193, 9.86, 0.72),
    ("Brasil_2018", 0.349, 0.321, 47.1, 1.41),
    ("España_2019", 0.051, 0.039, 3.12, 0.28),
]


def share_union(votes: DataFrame, seats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vote and seat shares of all parties of either side, 0 when absent."""
    both = votes.select(*keys, "party", "vote_share").join(
        seats.select(*keys, "party", "seat_share"), [*keys, "party"], "full"
    )
    return both.fillna(0.0, ["vote_share", "seat_share"])


def _gap() -> Column:
    return F.col("vote_share") * 100 - F.col("seat_share") * 100


def effective_parties(share: str) -> Column:
    """Aggregate ``1 / sum(p * p)`` over positive shares, null when none."""
    p = F.when(F.col(share) > 0, F.col(share))
    return 1 / F.sum(p * p)


def disproportionality(shares: DataFrame, keys: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """All five proportionality indices in one aggregation."""
    measures = {
        "gallagher": F.sqrt(F.sum(_gap() * _gap()) / 2),
        "loosemore_hanby": F.sum(F.abs(_gap())) / 2,
        "rae": F.avg(F.abs(_gap())),
        "enp_votes": effective_parties("vote_share"),
        "enp_seats": effective_parties("seat_share"),
    }
    return shares.groupBy(*keys).agg(
        *[(m if digits is None else rnd(m, digits)).alias(n) for n, m in measures.items()]
    )


def proportionality_summary(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    wide = disproportionality(shares, keys)
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), names, "indicator", "value")


def seat_bonus(shares: DataFrame) -> DataFrame:
    return shares.withColumn("seat_bonus", rnd(F.col("seat_share") * 100 - F.col("vote_share") * 100, 4))


def district_table(population: DataFrame, magnitudes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Districts present on both sides: population and magnitude."""
    on = [k for k in [*keys, "district"] if k in magnitudes.columns]
    return population.join(magnitudes.select(*on, "magnitude"), on)


def persons_per_seat(districts: DataFrame) -> DataFrame:
    return districts.withColumn("persons_per_seat", ratio(F.col("population"), F.col("magnitude")))


def relative_vote_weight(districts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Persons per seat against the mean over districts with seats."""
    valid = F.col("magnitude") > 0
    w = group_window(keys)
    mean = ratio(
        F.sum(F.when(valid, F.col("population"))).over(w), F.sum(F.when(valid, F.col("magnitude"))).over(w)
    )
    pps = persons_per_seat(districts)
    return pps.withColumn("_mean", mean).withColumn(
        "relative_weight", ratio(F.col("persons_per_seat"), F.col("_mean"))
    ).drop("_mean")


def weighted_balance(units: DataFrame, plan: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """Balance of districts against a seat-weighted ideal.

    Fails when a unit has no district or a district has no magnitude.
    """
    placed = units.join(plan, "unit_id", "left")
    district = ensure(F.col("district").isNotNull(), "unit without district", F.col("district"))
    pop = placed.groupBy(district.alias("district")).agg(F.sum("population").alias("population"))
    both = pop.join(magnitudes.select("district", "magnitude"), "district", "left").withColumn(
        "magnitude", ensure(F.col("magnitude").isNotNull(), "district without magnitude", F.col("magnitude"))
    )
    w = group_window(())
    total_seats, total_pop = F.sum("magnitude").over(w), F.sum("population").over(w)
    balanced = both.withColumn("ideal", total_pop * F.col("magnitude") / total_seats).withColumn(
        "deviation_pct", ratio(F.col("population") - F.col("ideal"), F.col("ideal")) * 100
    )
    return relative_vote_weight(balanced)


def _valid(districts: DataFrame) -> DataFrame:
    return persons_per_seat(districts.where("magnitude > 0 AND population IS NOT NULL"))


def samuels_snyder(districts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half the summed gap between seat share and population share."""
    w = group_window(keys)
    shares = _valid(districts).withColumns(
        {
            "_p": ratio(F.col("population"), F.sum("population").over(w)),
            "_m": ratio(F.col("magnitude"), F.sum("magnitude").over(w)),
        }
    )
    return shares.groupBy(*keys).agg(
        rnd(F.sum(F.abs(F.col("_m") - F.col("_p"))) / 2, 6).alias("samuels_snyder")
    )


def gini(districts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gini of persons per seat, weighted by population and unweighted.

    The pairwise sum becomes running sums over districts in order:
    ``sum_j p_j |x_i - x_j| = 2 * sum over earlier j of p_j (x_i - x_j)``
    counted once per pair.
    """
    w = group_window(keys)
    order = w.orderBy("persons_per_seat", "district")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x, p = F.col("persons_per_seat"), F.col("_p")
    shares = _valid(districts).withColumn("_p", ratio(F.col("population"), F.sum("population").over(w)))
    scanned = shares.withColumns(
        {
            "_pb": F.coalesce(F.sum("_p").over(before), F.lit(0.0)),
            "_pxb": F.coalesce(F.sum(p * x).over(before), F.lit(0.0)),
            "_rank": F.row_number().over(order),
        }
    )
    mu = F.sum(p * x)
    weighted = F.sum(p * (x * F.col("_pb") - F.col("_pxb"))) / mu
    n, mean = F.count(F.lit(1)), F.avg(x)
    plain = 2 / (n * n * mean) * F.sum(F.col("_rank") * x) - (n + 1) / n
    return scanned.groupBy(*keys).agg(
        F.when((n == 1) | (mu < 1e-12), 0.0).otherwise(rnd(weighted, 6)).alias("gini_weighted"),
        F.when((n == 1) | (mean < 1e-12), 0.0)
        .otherwise(rnd(F.greatest(plain, F.lit(0.0)), 6))
        .alias("gini_unweighted"),
    )


def max_min_ratio(districts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extremes of persons per seat and their ratio; ties to the first district."""
    x = F.col("persons_per_seat")
    top = F.max(F.struct(x, (-F.col("district")).alias("d")))
    low = F.min(F.struct(x, F.col("district").alias("d")))
    mean = ratio(F.sum("population"), F.sum("magnitude"))
    sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    agg = _valid(districts).groupBy(*keys).agg(
        top.alias("_top"), low.alias("_low"), mean.alias("_mean"), sd.alias("_sd")
    )
    high, least = F.col("_top.persons_per_seat"), F.col("_low.persons_per_seat")
    return agg.select(
        *keys,
        F.when(least > 0, rnd(high / least, 4)).otherwise(F.lit(float("inf"))).alias("max_min_ratio"),
        rnd(high, 1).alias("max_persons_per_seat"),
        (-F.col("_top.d")).alias("max_district"),
        rnd(least, 1).alias("min_persons_per_seat"),
        F.col("_low.d").alias("min_district"),
        rnd("_mean", 1).alias("mean_persons_per_seat"),
        rnd("_sd", 1).alias("sd_persons_per_seat"),
        F.when(F.col("_mean") > 0, rnd(F.col("_sd") / F.col("_mean"), 4)).alias("cv"),
    )


def malapportionment_summary(districts: DataFrame, keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """All malapportionment indices, one row per key."""
    keys = list(keys)
    sizes = _valid(districts).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_districts"),
        F.sum("magnitude").alias("total_seats"),
        F.sum("population").alias("total_population"),
    )
    out = sizes
    for part in (samuels_snyder(districts, keys), gini(districts, keys), max_min_ratio(districts, keys)):
        out = attach(out, part, keys)
    return out


def compare_plans(
    plans: DataFrame, population: DataFrame, magnitudes: DataFrame | None = None, lowest: int = 3, **bounds: int
) -> DataFrame:
    """Malapportionment of every plan at once; seats given or recomputed."""
    by_district = (
        plans.join(population, "unit_id", "left")
        .groupBy("plan_id", "district")
        .agg(F.sum(F.coalesce("population", F.lit(0))).alias("population"))
    )
    if magnitudes is None:
        seats = magnitudes_dhondt(by_district, ("plan_id",), lowest=lowest, **bounds)
    else:
        seats = by_district.join(magnitudes.select("district", "magnitude"), "district", "left").withColumn(
            "magnitude", F.coalesce("magnitude", F.lit(lowest))
        )
    return malapportionment_summary(seats, ("plan_id",))


def international_comparison(own: DataFrame) -> DataFrame:
    """Own rows next to published figures; columns label and four indices."""
    published = own.sparkSession.createDataFrame(
        LITERATURE, "label string, samuels_snyder double, gini_weighted double, max_min_ratio double, cv double"
    ).withColumn("kind", F.lit("benchmark"))
    return published.unionByName(own.withColumn("kind", F.lit("custom")), allowMissingColumns=True)
