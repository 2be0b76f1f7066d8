"""Tail probabilities as columns, and a seeded permutation of positions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal distribution.

    Near the middle by the power series of the area, farther out by the
    continued fraction of Mills' ratio.
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    zero = F.struct(F.lit(0.0).alias("sum"), x.cast("double").alias("term"))
    area = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), zero,
        lambda acc, k: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * x * x / (2 * k + 1)).alias("term")),
        lambda acc: acc["sum"],
    )
    mills = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x.cast("double"), lambda f, k: x + k / f)
    return F.when(x < 3, 0.5 - density * area).otherwise(density / mills)


def kolmogorov_tail(x: Column, terms: int = 101) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov probability of ``x`` or more."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def shuffled(position: Column, size: Column, seed: Column, rounds: int = 16) -> Column:
    """Image of ``position`` under a pseudo-random permutation of 0..size-1.

    A swap-or-not shuffle: every round pairs position i with (k - i) mod size
    and swaps the pair on a hashed coin. Each row is computed on its own, so a
    permutation of any size needs neither a sort nor a common task.
    """
    def step(i: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(seed, r), size)
        other = F.pmod(key - i, size)
        coin = F.pmod(F.xxhash64(seed, r, F.greatest(i, other)), F.lit(2)) == 1
        return F.when(coin, other).otherwise(i)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), position.cast("long"), step)


#: degrees of freedom up to which Student's tail is summed term by term
TERMS = 100_000


def student_two_sided(r: Column, df: Column) -> Column:
    """P(|T| > |t|) for the t of a correlation ``r`` with ``df`` degrees of freedom.

    With cos^2 = 1 - r^2 the tail is a finite series for whole ``df``; beyond
    ``TERMS`` a normal deviate of the same tail is used.
    """
    s, c2 = F.abs(r), 1 - r * r
    cos = F.sqrt(F.greatest(c2, F.lit(0.0)))
    odd = df % 2 == 1

    def series(first: Column, steps: Column, top: int) -> Column:
        """first * (1 + c2 * a1 + c2^2 * a1 a2 + ..), a_k = (2k - 1 + top) / (2k + top)."""
        zero = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
        ks = F.when(steps > 0, F.sequence(F.lit(1), steps.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            ks, zero,
            lambda acc, k: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * c2 * (2 * k - 1 + top) / (2 * k + top)).alias("term")),
            lambda acc: acc["sum"],
        )

    angle = F.atan2(s, cos)
    inside = F.when(odd, (angle + s * series(cos, (df - 1) / 2, 1)) * (2 / math.pi)).otherwise(s * series(F.lit(1.0), df / 2, 0))
    t2 = F.try_divide(r * r * df, c2)
    z = F.sqrt(df * F.log1p(t2 / df)) * (8 * df + 1) / (8 * df + 3)
    exact = F.greatest(F.lit(0.0), 1 - inside)
    return F.when(df < 1, F.lit(None)).when(c2 <= 0, 0.0).when(df <= TERMS, exact).otherwise(2 * normal_tail(z))


def inversions_two_sided(count: Column, n: Column) -> Column:
    """Twice the chance that a random order of ``n`` has at most as many, or as few, inversions.

    The chances of 0, 1, .. inversions are convolved item by item, as far as
    the smaller of ``count`` and its mirror image.
    """
    low = F.least(count, (n * (n - 1) / 2).cast("long") - count).cast("int")
    start = F.transform(F.sequence(F.lit(0), low), lambda d: F.when(d == 0, 1.0).otherwise(0.0))

    def insert(p: Column, i: Column) -> Column:
        def chance(d: Column) -> Column:
            own = F.slice(p, F.greatest(d - i + 2, F.lit(1)), F.least(i, d + 1))
            return F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / i

        return F.transform(F.sequence(F.lit(0), low), chance)

    steps = F.when(n > 1, F.sequence(F.lit(2), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(F.aggregate(steps, start, insert), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * below)


def smirnov_two_sided(d: float, m: int, n: int) -> float:
    """Exact chance of a two-sample Kolmogorov-Smirnov statistic of ``d`` or more.

    Of all orders of m and n values, ``stay[i]`` is the share of those through
    (i, s - i) that were inside the band |i/m - j/n| < d so far; it is carried
    from one diagonal to the next. Time grows with m + n times the band's width.
    """
    edge = (0.5 + math.floor(d * m * n - 1e-7)) / (m * n)
    slope = 1 / m + 1 / n
    stay = np.zeros(m + 2)  # the last place stands before the first
    stay[0] = 1.0
    for s in range(1, m + n + 1):
        low = max(0, s - n, math.ceil((s / n - edge) / slope - 1e-9))
        high = min(m, s, math.floor((s / n + edge) / slope + 1e-9))
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        part = stay[i - 1] * (i / s) + stay[i] * ((s - i) / s)
        stay[max(0, low - 1) : high + 2] = 0
        stay[low : high + 1] = part
        stay[m + 1] = 0
    return float(min(1.0, max(0.0, 1 - stay[m])))
