"""Tails against enumeration and numerical integration."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from hemicycle.functions.probability import inversions_two_sided, normal_tail, smirnov_two_sided, student_two_sided
from hemicycle.operators import ensemble


def test_normal(spark):
    zs = [0.0, 0.3, 1.0, 1.96, -2.5, 2.99, 3.01, 5.0, 9.0, 30.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)) / 2, rel=1e-9) for r in rows)


def test_student(spark):
    """The density of t integrated by Simpson's rule over an angle."""
    cases = [(r, df) for r in (-0.99, -0.3, 0.0, 0.5, 0.9) for df in (1, 2, 3, 4, 9, 30, 201)] + [(1.0, 3), (0.4, 0)]
    rows = spark.createDataFrame(cases, "r double, df int").select("r", "df", student_two_sided(F.col("r"), F.col("df")).alias("p")).collect()
    for row in rows:
        if row.df < 1:
            assert row.p is None
            continue
        steps, top = 4000, math.asin(min(1.0, abs(row.r)))
        weights = [1 if i in (0, steps) else 4 if i % 2 else 2 for i in range(steps + 1)]
        part = sum(w * math.cos(top * i / steps) ** (row.df - 1) for i, w in enumerate(weights)) * top / steps / 3
        whole = math.sqrt(math.pi) * math.exp(math.lgamma(row.df / 2) - math.lgamma((row.df + 1) / 2)) / 2
        assert row.p == pytest.approx(1 - part / whole, abs=1e-9)


def test_inversions(spark):
    for n in (2, 3, 5, 6):
        found = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        top = n * (n - 1) // 2
        rows = spark.range(top + 1).select("id", inversions_two_sided(F.col("id"), F.lit(n)).alias("p")).collect()
        for r in rows:
            low = min(r.id, top - r.id)
            assert r.p == pytest.approx(min(1, 2 * sum(x <= low for x in found) / len(found)))


@pytest.mark.parametrize("m, n", [(1, 1), (2, 3), (4, 4), (3, 7), (5, 6)])
def test_smirnov(m, n):
    gaps = []
    for ones in itertools.combinations(range(m + n), m):
        i = j = 0
        most = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in ones else (i, j + 1)
            most = max(most, abs(i * n - j * m))
        gaps.append(most)
    for d in sorted(set(gaps)):
        assert smirnov_two_sided(d / (m * n), m, n) == pytest.approx(sum(g >= d for g in gaps) / len(gaps))
        assert smirnov_two_sided(d / (m * n), n, m) == smirnov_two_sided(d / (m * n), m, n)


def test_smirnov_large():
    """Near the limit law for large samples."""
    m = n = 3000
    d = 1.0 / math.sqrt(m * n / (m + n))
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k) for k in range(1, 50))
    assert smirnov_two_sided(d, m, n) == pytest.approx(series, abs=0.02)


def test_p_values_of_comparisons(spark):
    rows = [("a", i, float(i)) for i in range(6)] + [("b", i, float(i + 3)) for i in range(5)]
    one = ensemble.compare_sensitivity(spark.createDataFrame(rows, "scenario string, plan_id int, max_dev_pct double"), ["max_dev_pct"]).first()
    assert (one.ks_stat, one.ks_pvalue) == (0.5, round(smirnov_two_sided(0.5, 6, 5), 6))
    few = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(1.0, 2.0), (2.0, 1.0), (3.0, 3.0), (4.0, 4.0)])], "item int, a double, b double")
    row = ensemble.ranking_concordance(few).first()
    assert (row.discordant, row.kendall_pval) == (1, pytest.approx(2 * 4 / 24, abs=1e-6)) and row.spearman_pval == pytest.approx(0.2, abs=1e-6)
