"""Fronts, concordance, chains and the sweep against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.operators import chains, ensemble, integrity, pareto
from hemicycle.plans import table


def brute_front(points):
    return [not any(all(o <= p for o, p in zip(other, own)) and other != own for other in points) for own in points]


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_pareto(spark, dims):
    rng = np.random.default_rng(dims)
    points = [tuple(map(float, p)) for p in rng.integers(0, 9, (400, dims))]
    names = [f"d{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.is_pareto for r in pareto.pareto(df, dict.fromkeys(names, True)).collect()}
    assert [got[i] for i in range(400)] == brute_front(points)


def test_pareto_blocks(spark):
    rng = np.random.default_rng(4)
    points = rng.random((300, 3))
    points = points / points.sum(axis=1, keepdims=True)  # nothing dominates anything
    df = spark.createDataFrame(points.tolist(), "a double, b double, c double")
    assert pareto.front_nd(df, ["a", "b", "c"], block=70).count() == 300


def test_missing_points_are_never_dominated(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, float("nan"), 9.0)], "id int, x double, y double")
    assert {r.id for r in pareto.pareto(df, {"x": True, "y": True}).where("is_pareto").collect()} == {1, 3}
    assert {r.id for r in pareto.tradeoff_frontier(df, "x", "y").where("is_pareto").collect()} == {1}


def test_knee_of_one_point(spark):
    one = spark.createDataFrame([(2.0, 3.0, 0.5)], "x double, y double, penalty double")
    row = pareto.knee_point(one, "x", "y").first()
    assert (row.knee_index, row.knee_x, row.knee_penalty, row.diminishing_start_x) == (0, 2.0, 0.5, None)
    assert pareto.knee_point(one.where("x > 5"), "x", "y").first().knee_index is None


def test_bootstrap_bands(spark):
    rng = np.random.default_rng(6)
    rows = [(float(p), float(x), float(10 - x + rng.random())) for p in range(4) for x in rng.random(30) * 9]
    df = spark.createDataFrame(rows, "penalty double, x double, y double")
    bands = pareto.bootstrap_bands(df, "x", "y", replicates=25, points=20).orderBy("grid").collect()
    assert [r.grid for r in bands] == list(range(20))
    assert all(r.y_p5 <= r.y_p25 <= r.y_p50 <= r.y_p75 <= r.y_p95 for r in bands)
    assert bands[0].y_p50 > bands[-1].y_p50
    assert pareto.bootstrap_bands(df.limit(3), "x", "y", 25).count() == 0
    assert pareto.bootstrap_bands(df, "x", "y", 5).count() == 0


@pytest.mark.parametrize("levels", [3, 1000])
def test_concordance(spark, levels):
    rng = np.random.default_rng(levels)
    a, b = rng.integers(0, levels, 120), rng.integers(0, levels, 120)
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "item int, a long, b long")
    row = ensemble.ranking_concordance(df).first()
    sign = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i, j in itertools.combinations(range(120), 2)]
    product = np.array([x * y for x, y in sign])
    tau = product.sum() / np.sqrt(sum(x != 0 for x, _ in sign) * sum(y != 0 for _, y in sign))
    assert row.discordant == (product < 0).sum()
    assert row.kendall_tau == pytest.approx(tau, abs=1e-4)
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert row.spearman_rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], abs=1e-4)


def test_concordance_of_few(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "item int, a double, b double")
    row = ensemble.ranking_concordance(df).first()
    assert row.kendall_tau is None and row.low_power


def chain_rows(spark, monkeypatch):
    monkeypatch.setattr(chains, "_BLOCK", 64)
    rng = np.random.default_rng(0)
    series = {c: np.cumsum(rng.normal(size=300 + 7 * c)) * 0.1 + rng.normal(size=300 + 7 * c) for c in range(3)}
    rows = [("m", c, i, float(v)) for c, s in series.items() for i, v in enumerate(s)]
    return series, spark.createDataFrame(rows, "metric string, chain int, step int, value double")


def test_chains(spark, monkeypatch):
    series, df = chain_rows(spark, monkeypatch)

    def rho(x, top):
        x = x - x.mean()
        return [float(x[: len(x) - k] @ x[k:] / (x @ x)) for k in range(top + 1)]

    got = {(r.chain, r.lag): r.acf for r in chains.acf(df, 60).collect()}
    for c, s in series.items():
        assert [got[c, k] for k in range(61)] == pytest.approx(rho(s, 60))
    monkeypatch.setattr(chains, "_BLOCK", 256)
    size = {r.chain: r.ess for r in chains.effective_sample_size(df).collect()}
    for c, s in series.items():
        r = rho(s, min(200, len(s) // 2))
        last = 1
        for k in range(1, len(r)):
            if r[k] < 0.05:
                break
            last = k
        assert size[c] == pytest.approx(len(s) / max(1 + 2 * sum(r[1 : last + 1]), 1))

    def rhat(t):
        d = np.array([s[:t] for s in series.values()])
        k, n = d.shape
        between, within = n * d.mean(axis=1).var(ddof=1), d.var(axis=1, ddof=1).mean()
        return np.sqrt(((n - 1) / n * within + (k + 1) / (k * n) * between) / within)

    assert chains.gelman_rubin(df).first().rhat == pytest.approx(rhat(300))
    evolution = {r.t: r.rhat for r in chains.gelman_rubin_evolution(df).collect()}
    assert len(evolution) == 291
    assert [evolution[t] for t in (10, 77, 300)] == pytest.approx([rhat(t) for t in (10, 77, 300)])


def test_constant_chain(spark):
    df = spark.range(20).select(F.lit("m").alias("metric"), (F.col("id") % 2).alias("chain"), "id", F.lit(3.0).alias("value")).withColumnRenamed("id", "step")
    assert {r.acf for r in chains.acf(df, 3).collect()} == {0.0}
    assert chains.gelman_rubin(df).first().rhat is None


def test_ties_share_the_rank(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0)], "scenario string, max_dev_pct_median double")
    got = {r.scenario: r["rank"] for r in ensemble.rank_scenarios(table, {"max_dev_pct": 1.0}).collect()}
    assert got == {"a": 1, "b": 1, "c": 3}


def test_effective_size_of_a_slow_chain(spark):
    """A random walk keeps its autocorrelation: every lag counts."""
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=400))
    rows = [("m", 0, i, float(v)) for i, v in enumerate(walk + 50 * np.arange(400))]
    x = walk + 50 * np.arange(400)
    x = x - x.mean()
    rho = [float(x[: 400 - lag] @ x[lag:] / (x @ x)) for lag in range(1, 41)]
    assert min(rho) > 0.05
    got = chains.effective_sample_size(spark.createDataFrame(rows, "metric string, chain int, position long, value double"), 40).first()
    assert abs(got.ess - 400 / (1 + 2 * sum(rho))) < 1e-6


def test_evenly_spaced_has_the_last_plan(spark):
    plans = spark.range(32).selectExpr("cast(id as int) plan_id", "1 unit_id", "1 district")
    got = sorted(r.plan_id for r in table.evenly_spaced_plans(plans, 30).collect())
    assert got == np.linspace(0, 31, 30).astype(int).tolist()


def test_feasibility_of_text_ids(spark):
    units = spark.createDataFrame([("01101_001", 5.0), ("01101_002", 7.0), ("00500_003", 7.0)], "unit_id string, population double")
    assert integrity.population_feasibility(units, 2, 0.1).first().largest_unit == "00500_003"
