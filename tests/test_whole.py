"""Queries and operators that once did less than the whole job."""

import numpy as np
import pytest

import __spark_entry__ as driver
from hemicycle.operators import chains, spatial
from test_catalogue import test_against_sql as check


@pytest.mark.parametrize("name", ["q1_seats_matrix_wide", "i9_sweep", "i8_ranking_concordance", "i15_weight_sensitivity"])
def test_all_districts_and_scenarios(spark, sf, name):
    check(spark, sf, name)


def test_convergence_is_shown(spark, sf):
    assert {r.converged for r in driver.queries()["q3_fair_share_biproportional"](spark, sf).select("converged").distinct().collect()} == {True}


def test_long_lags(spark, monkeypatch):
    monkeypatch.setattr(chains, "_BLOCK", 64)
    x = np.random.default_rng(4).normal(size=300).cumsum()
    df = spark.createDataFrame([("m", 0, i, float(v)) for i, v in enumerate(x)], "metric string, chain int, step int, value double")
    got = {r.lag: r.acf for r in chains.acf(df, 150).collect()}
    z = x - x.mean()
    assert set(got) == set(range(151))
    assert all(abs(got[k] - z[: 300 - k] @ z[k:] / (z @ z)) < 1e-9 for k in got)


def test_scopes_take_permutations(spark):
    units = spark.createDataFrame([(i, i // 10, float(i % 10)) for i in range(20)], "unit_id long, g long, v double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)], "src long, dst long")
    found = {r.place: r for r in spatial.autocorrelation_scopes(units, edges, {"group": "g"}, ["v"], 99).collect()}
    assert set(found) == {"0", "1"} and all(r.n == 10 and r.moran_i > 0.6 and r.p_sim <= 0.05 for r in found.values())
