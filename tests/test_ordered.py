"""Running totals, quantiles, shuffles and tails against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.functions.ordered import exact_quantiles, row_index, running
from hemicycle.functions.probability import kolmogorov_tail, normal_tail, shuffled
from hemicycle.functions.stats import dist_stats, ecdf, histogram


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    # one group holds most rows
    rows = [("hot" if i % 5 else "cold", i, int(v)) for i, v in enumerate(rng.integers(0, 200, 3000))]
    return rows, spark.createDataFrame(rows, "k string, i long, v long").repartition(7).cache()


def test_running_crosses_slices(values):
    rows, df = values
    out = running(df, ["k"], ["v", "i"], {"s": ("sum", "v"), "m": ("max", "i")}).collect()
    slices = running(df, ["k"], ["v", "i"], {"s": ("sum", "v")})
    assert slices.count() == len(rows)
    for key in ("hot", "cold"):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        got = {r.i: (r.s, r.m) for r in out if r.k == key}
        total, top = 0, -1
        for _, i, v in ordered:
            total, top = total + v, max(top, i)
            assert got[i] == (total, top)


def test_exclusive_and_index(values):
    rows, df = values
    got = {r.i: r.n for r in row_index(df, (), [F.col("v").desc(), "i"], "n").collect()}
    ordered = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert got == {r[1]: n for n, r in enumerate(ordered)}


def test_quantiles(values):
    rows, df = values
    probs = {"p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        data = [v for k, _, v in rows if k == r.k]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(data, 100 * p))


def test_dist_stats_of_one_value_and_nan(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", float("nan"))], "k string, v double")
    got = {r.k: r for r in dist_stats(df, "v", ["k"]).collect()}
    assert (got["a"].std, got["a"].n, got["a"].ci95_low) == (0.0, 1, 2.0)
    assert (got["b"].mean, got["b"].median, got["b"].n) == (2.0, 2.0, 2)


def test_ecdf_and_histogram(values, spark):
    rows, df = values
    hot = np.array([v for k, _, v in rows if k == "hot"])
    steps = {r.value: r.share for r in ecdf(df.where("k = 'hot'"), "v").collect()}
    assert all(s == pytest.approx((hot <= v).mean()) for v, s in steps.items())
    counts, _ = np.histogram(hot, bins=12)
    got = {r.bin: r.n for r in histogram(df.where("k = 'hot'"), "v", 12).collect()}
    assert [got.get(i, 0) for i in range(12)] == counts.tolist()
    flat = histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 10).collect()
    assert sum(r.n for r in flat) == 4


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_shuffle_is_a_permutation(spark, size):
    df = spark.range(size).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(4))))
    rows = df.select("seed", shuffled(F.col("id"), F.lit(size), F.col("seed")).alias("p")).collect()
    images = {s: [r.p for r in rows if r.seed == s] for s in range(1, 5)}
    assert all(sorted(p) == list(range(size)) for p in images.values())
    if size == 100:
        assert images[1] != images[2]


def test_tails(spark):
    row = spark.range(1).select(normal_tail(F.lit(1.96)).alias("n"), kolmogorov_tail(F.lit(1.0)).alias("k")).first()
    assert row.n == pytest.approx(math.erfc(1.96 / math.sqrt(2)) / 2, rel=1e-6)
    assert row.k == pytest.approx(0.26999967, abs=1e-7)
