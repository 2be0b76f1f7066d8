"""The quadtree join against all pairs: crowded spots, ranks, exclusions."""

import math
import random

import pytest

from hemicycle.functions import nearest as module
from hemicycle.functions.nearest import nearest
from hemicycle.operators import graph

POINT = "unit_id long, x double, y double, place long"


def cloud(seed, n):
    """Clusters of very different density, equal points, and some far away."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        kind = draw.randrange(5)
        x, y = [(1.0, 2.0), (draw.gauss(0, 1e-3), draw.gauss(0, 1e-3)), (draw.randrange(6), draw.randrange(6)), (draw.uniform(-1e5, 1e5), draw.uniform(0, 1)), (draw.gauss(50, 3), draw.gauss(50, 3))][kind]
        rows.append((i, float(x), float(y), draw.randrange(6)))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(module, "LEAF", 3)
    rows = cloud(seed, 260)
    left, right = rows[::3], rows
    barred = {(i, j) for i, *_ in left[::5] for j in range(0, 60, 7)}
    data = spark.createDataFrame(rows + [(999, None, 1.0, 0)], POINT)
    some = data.where("unit_id % 3 = 0")
    shut = spark.createDataFrame(sorted(barred), "unit_id long, near_id long")

    def brute(skip, ranked):
        out = {}
        for i, x, y, p in left:
            near = [(float(f"{math.hypot(x - a, y - b):.12g}"), j) for j, a, b, q in right if (q < p if ranked else i != j) and (i, j) not in skip]
            if near:
                out[i] = min(near)
        return out

    def found(df):
        return {r.unit_id: (float(f"{r.distance:.12g}"), r.near_id) for r in df.collect()}

    assert found(nearest(some, data)) == brute(set(), False)
    assert found(nearest(some, data, shut)) == brute(barred, False)
    assert found(nearest(some, data, earlier="place")) == brute(set(), True)
    # with a group only the nearest pair of the group is promised
    group = found(nearest(some, data, earlier="place", group="place"))
    all_ = brute(set(), True)
    for p in range(1, 6):
        own = [i for i, *_, q in left if q == p and i in all_]
        assert min((all_[i][0], i, all_[i][1]) for i in own) == min((group[i][0], i, group[i][1]) for i in own if i in group)
    assert nearest(some, data.limit(0)).collect() == []
    assert nearest(some.limit(0), data).collect() == []


def test_one_large_component(spark):
    """A component of 100,000 nodes meets small ones without pairs of its own."""
    side = 316
    grid = spark.range(side * side).selectExpr("id as unit_id", f"cast(id % {side} as double) * 10 as x", f"cast(id div {side} as double) * 10 as y", "0L as place")
    few = spark.createDataFrame([(200_000, -50.0, 33.0, 1), (200_001, -60.0, 33.0, 1), (300_000, 9000.0, 9000.0, 2)], POINT)
    nodes = grid.union(few)
    got = {r.unit_id: r.near_id for r in nearest(nodes.where("place > 0"), nodes, earlier="place", group="place").collect()}
    assert got[200_000] == 3 * side and got[300_000] == side * side - 1
    back = nearest(nodes.selectExpr("unit_id", "x", "y", "3 - place as place"), nodes.selectExpr("unit_id", "x", "y", "3 - place as place"), earlier="place", group="place")
    found = {(r.unit_id, r.near_id) for r in back.collect()}
    assert (3 * side, 200_000) in found and len(found) < 100


@pytest.mark.parametrize("seed", [5, 9])
def test_diameter(spark, seed):
    """Bounds close on the longest path of random trees with a few extra edges."""
    draw = random.Random(seed)
    n = 40
    edges = [(draw.randrange(max(0, i - 2 * seed), i), i) for i in range(1, n)] + [(draw.randrange(n), draw.randrange(n)) for _ in range(seed - 5)]
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    longest = 0
    for i in range(n):
        hops, front = {i: 0}, [i]
        while front:
            front = list({j for u in front for j in near[u]} - set(hops))
            hops |= {j: max(hops.values()) + 1 for j in front}
        longest = max(longest, max(hops.values()))
    table = spark.createDataFrame(edges, "src long, dst long")
    assert graph.diameter(spark.range(n).withColumnRenamed("id", "unit_id"), table) == longest
    reached = graph.hop_counts(graph.both_ways(table), [0, 1, 2])
    assert reached.count() <= 3 * n and reached.agg({"unit_id": "max"}).first()[0] == n - 1
