"""Indices, fair shares and plan metrics on small hand cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.operators import fairshare, indices, seats
from hemicycle.plans import metrics


def districts(spark, pop, mag):
    return spark.createDataFrame([(i, p, m) for i, (p, m) in enumerate(zip(pop, mag), 1)], "district int, population long, magnitude int")


def test_samuels_snyder(spark):
    assert indices.samuels_snyder(districts(spark, [900, 100], [1, 1])).first()[0] == 0.4
    assert indices.samuels_snyder(districts(spark, [500, 300], [5, 3])).first()[0] == 0.0


def test_gini_against_pairs(spark):
    rng = np.random.default_rng(3)
    pop, mag = rng.integers(1, 900, 40), rng.integers(1, 9, 40)
    x, p = pop / mag, pop / pop.sum()
    expected = (np.abs(x[:, None] - x[None, :]) * np.outer(p, p)).sum() / (2 * (p * x).sum())
    row = indices.gini(districts(spark, pop.tolist(), mag.tolist())).first()
    assert row.gini_weighted == pytest.approx(expected, abs=1e-6)
    xs = np.sort(x)
    plain = 2 / (40 * 40 * xs.mean()) * (np.arange(1, 41) * xs).sum() - 41 / 40
    assert row.gini_unweighted == pytest.approx(plain, abs=1e-6)


def test_ratio_edge_cases(spark):
    row = indices.max_min_ratio(districts(spark, [0, 100, 5], [1, 1, 0])).first()
    assert row.max_min_ratio == float("inf") and row.max_district == 2 and row.min_district == 1
    assert indices.gini(districts(spark, [10], [2])).first().gini_weighted == 0.0


def test_weighted_balance_checks(spark):
    units = spark.createDataFrame([(1, 10), (2, 30)], "unit_id long, population long")
    plan = spark.createDataFrame([(1, 1)], "unit_id long, district int")
    mags = spark.createDataFrame([(1, 3)], "district int, magnitude int")
    with pytest.raises(Exception, match="unit without district"):
        indices.weighted_balance(units, plan, mags).collect()


def test_disproportionality_of_missing_party(spark):
    v = spark.createDataFrame([("A", 0.6), ("B", 0.4)], "party string, vote_share double")
    s = spark.createDataFrame([("A", 1.0)], "party string, seat_share double")
    row = indices.disproportionality(indices.share_union(v, s)).first()
    assert (row.gallagher, row.loosemore_hanby, row.rae, row.enp_seats) == (40.0, 40.0, 40.0, 1.0)


def fair_inputs(spark):
    votes = spark.createDataFrame([(1, "A", 600), (1, "B", 400), (2, "A", 200), (2, "B", 800)], "district int, party string, votes long")
    return votes, spark.createDataFrame([(1, 5), (2, 5)], "district int, magnitude int")


def test_fair_share(spark):
    votes, mags = fair_inputs(spark)
    district = {(r.party, r.district): r.fair_share for r in fairshare.fair_share_district(votes, mags).collect()}
    assert district == {("A", 1): 3.0, ("B", 1): 2.0, ("A", 2): 1.0, ("B", 2): 4.0}
    fitted, done = fairshare.fair_share_biproportional(votes, mags)
    rows = fitted.collect()
    assert done
    assert sum(r.fair_share for r in rows if r.party == "A") == pytest.approx(4.0)
    assert sum(r.fair_share for r in rows if r.district == 1) == pytest.approx(5.0)
    by_plan = fairshare.fair_share_biproportional_by_plan(votes.withColumn("plan_id", F.lit(7)), mags).collect()
    assert all(r.converged for r in by_plan)
    assert {(r.party, r.district): round(r.fair_share, 8) for r in by_plan} == {(r.party, r.district): round(r.fair_share, 8) for r in rows}


def test_fair_share_rejects_bad_input(spark):
    votes, mags = fair_inputs(spark)
    with pytest.raises(Exception, match="positive magnitude"):
        fairshare.fair_share_district(votes, mags.where("district = 1")).collect()
    with pytest.raises(Exception, match="negative votes"):
        fairshare.fair_share_district(votes.withColumn("votes", -F.col("votes")), mags).collect()


def ensemble(spark):
    votes = spark.createDataFrame(
        [(u, p, v) for u, row in enumerate([(60, 30, 10), (20, 50, 30), (40, 40, 20), (10, 20, 70)], 1) for p, v in zip("ABC", row)],
        "unit_id long, party string, votes long")
    pop = spark.createDataFrame([(u, 100 * u) for u in range(1, 5)], "unit_id long, population long")
    mags = spark.createDataFrame([(1, 3), (2, 4)], "district int, magnitude int")
    plans = spark.createDataFrame(
        [(p, u, d) for p, ds in enumerate([(1, 1, 2, 2), (1, 2, 1, 2), (1, 2, 2, 1)]) for u, d in enumerate(ds, 1)],
        "plan_id int, unit_id long, district int")
    return plans, votes, pop, mags


def test_all_plans_equal_each_plan_alone(spark):
    plans, votes, pop, mags = ensemble(spark)
    pacts = spark.createDataFrame([("á", "P1"), ("b", "P1")], "party string, pact string")
    together = {r.plan_id: r for r in metrics.plan_electoral_metrics(plans, votes, pop, mags, pacts).collect()}
    assert len(together) == 3
    for plan in range(3):
        alone = metrics.plan_electoral_metrics(plans.where(F.col("plan_id") == plan), votes, pop, mags, pacts).first()
        assert alone == together[plan]
    assert together[0].allocation_mode == "two_level" and together[0].magnitude_mode == "fixed"


def test_missing_magnitude(spark):
    plans, votes, pop, mags = ensemble(spark)
    with pytest.raises(Exception, match="no magnitude"):
        metrics.plan_electoral_metrics(plans, votes, pop, mags.where("district = 1")).collect()
    skipped = metrics.electoral_ensemble(plans, votes, pop, mags.where("district = 1"), parties=["A"]).collect()
    assert len(skipped) == 3 and "seat_bonus_A" in skipped[0].asDict()


def test_seats_sum_to_magnitude(spark):
    plans, votes, pop, mags = ensemble(spark)
    cast = metrics.assign_votes(votes, plans)
    won = seats.run_plan(cast, mags, ("plan_id", "district")).groupBy("plan_id").agg(F.sum("seats").alias("s")).collect()
    assert {r.s for r in won} == {7}
