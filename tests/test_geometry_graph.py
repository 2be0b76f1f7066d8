"""Shapes, graphs and spatial statistics against direct computation."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.operators import geometry, graph, integrity, spatial

VERTEX = "unit_id long, part int, ring int, seq int, x double, y double"


def polygon(unit, points, ring=0):
    closed = [*points, points[0]]
    return [(unit, 0, ring, i, float(x), float(y)) for i, (x, y) in enumerate(closed)]


def smallest_circle(points):
    best = math.inf
    for a, b in itertools.combinations(points, 2):
        c, r = (a + b) / 2, np.linalg.norm(a - b) / 2
        if r < best and (np.linalg.norm(points - c, axis=1) <= r + 1e-9).all():
            best = r
    for a, b, c in itertools.combinations(points, 3):
        d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        if abs(d) < 1e-12:
            continue
        u, v = b - a, c - a
        o = a + np.array([v[1] * (u @ u) - u[1] * (v @ v), u[0] * (v @ v) - v[0] * (u @ u)]) / d
        r = np.linalg.norm(o - a)
        if r < best and (np.linalg.norm(points - o, axis=1) <= r + 1e-9).all():
            best = r
    return best


def test_shape_scores(spark):
    circle = [(math.cos(t), math.sin(t)) for t in np.linspace(0, 2 * math.pi, 257)[:-1]]
    rows = polygon(1, circle) + polygon(2, [(0, 0), (1, 0), (1, 1), (0, 1)]) + polygon(3, [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)])
    got = {r.unit_id: r for r in geometry.compactness(spark.createDataFrame(rows, VERTEX)).collect()}
    assert got[1].polsby_popper == pytest.approx(1, abs=1e-3) and got[1].reock == pytest.approx(1, abs=1e-3)
    assert got[2].polsby_popper == pytest.approx(math.pi / 4) and got[2].reock == pytest.approx(2 / math.pi)
    assert got[2].convex_hull_ratio == pytest.approx(1) and 0 < got[3].convex_hull_ratio < 1


def test_circles_of_random_points(spark):
    rng = np.random.default_rng(8)
    clouds = {g: rng.normal(size=(rng.integers(1, 25), 2)) * 10 ** rng.integers(0, 4) for g in range(25)}
    rows = [(g, float(x), float(y)) for g, c in clouds.items() for x, y in c]
    got = geometry.enclosing_circles(spark.createDataFrame(rows, "g int, x double, y double"), ["g"]).collect()
    assert len(got) == len(clouds)
    for r in got:
        expected = smallest_circle(clouds[r.g]) if len(clouds[r.g]) > 1 else 0.0
        assert (r.r if math.isfinite(r.r) else 0.0) == pytest.approx(expected, rel=1e-6, abs=1e-9)


def test_hole_and_orientation(spark):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    rows = polygon(1, ring) + polygon(1, hole, 1) + polygon(2, ring[::-1]) + polygon(2, hole[::-1], 1)
    df = spark.createDataFrame(rows, VERTEX)
    assert {(r.area, r.perimeter) for r in geometry.area_perimeter(df).collect()} == {(15.0, 20.0)}
    for r in geometry.centroid(df).collect():
        assert (r.x, r.y) == pytest.approx(((16 * 2 - 1.5) / 15, (16 * 2 - 1.5) / 15))


def test_utm(spark):
    point = spark.createDataFrame([(-70.65, -33.45)], "lon double, lat double")
    row = geometry.project_utm(point).first()
    assert (row.zone, row.epsg) == (19, 32719)
    assert row.x == pytest.approx(346_672, abs=60) and row.y == pytest.approx(6_297_565, abs=700)


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, c in edges:
        a, c = root(a), root(c)
        parent[max(a, c)] = min(a, c)
    return {n: root(n) for n in nodes}


def test_components(spark):
    draw = random.Random(2)
    rows, nodes, expected = [], [], {}
    for plan in range(6):
        edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(10 * plan)] + [(i, i + 1) for i in range(60, 95)]
        draw.shuffle(edges)
        nodes += [(plan, n) for n in range(96)]
        rows += [(plan, a, c) for a, c in edges]
        expected |= {(plan, n): c for n, c in components_of(range(96), edges).items()}
    got = graph.connected_components(
        spark.createDataFrame(nodes, "plan_id int, unit_id long"), spark.createDataFrame(rows, "plan_id int, src long, dst long"), ["plan_id"]).collect()
    assert {(r.plan_id, r.unit_id): r.component for r in got} == expected


def test_contiguity_and_cuts(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    plans = spark.createDataFrame(
        [(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 2), (1, 1, 1), (1, 2, 2), (1, 3, 1), (2, 1, 1)], "plan_id int, unit_id long, district int")
    cut = {r.plan_id: r.cut_edges for r in graph.cut_edges(edges, plans).collect()}
    assert cut == {0: 1, 1: 3, 2: 1}  # an unassigned end differs, two unassigned ends agree
    joined = {(r.plan_id, r.district): r.contiguous for r in graph.contiguity(edges, plans).collect()}
    assert joined == {(0, 1): True, (0, 2): True, (1, 1): False, (1, 2): True, (2, 1): True}


def places(seed, n=40):
    draw = random.Random(seed)
    return {i: (draw.uniform(0, 5000), draw.uniform(0, 5000)) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_one_after_another(spark, seed):
    at = places(seed)
    linked = [(a, a + 1) for a in range(0, 20)]
    chosen, new = {}, set()
    for i in range(21, 40):
        free = [j for j in at if j != i and (j, i) not in new]
        chosen[i] = min(free, key=lambda j: (math.dist(at[i], at[j]), j))
        new.add((i, chosen[i]))
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()], "unit_id long, x double, y double")
    got = graph.connect_islands(nodes, spark.createDataFrame(linked, "src long, dst long")).collect()
    assert {r.unit_id: r.near_id for r in got} == chosen


def test_components_joined_by_closest_pair(spark):
    at = places(9)
    linked = [(a, a + 1) for a in range(0, 15)] + [(20, 21), (21, 22), (25, 26)]
    comp = components_of(at, linked)
    groups = {}
    for n, c in comp.items():
        groups.setdefault(c, []).append(n)
    order = sorted(groups, key=lambda c: (-len(groups[c]), c))
    main, expected = list(groups[order[0]]), {}
    for c in order[1:]:
        expected[c] = min((math.dist(at[a], at[z]), a, z) for a in groups[c] for z in main)[1:]
        main += groups[c]
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()], "unit_id long, x double, y double")
    got = graph.connect_components(nodes, spark.createDataFrame(linked, "src long, dst long")).collect()
    assert {r.component: (r.src, r.dst) for r in got} == expected


def test_diameter(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "unit_id long")
    line = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert graph.graph_stats(nodes, line).first().diameter == 5
    assert graph.graph_stats(nodes, line.where("src <> 2")).first().diameter is None


def grid(spark, n=12):
    edges = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, (i + 1) * n + j) for i in range(n - 1) for j in range(n)]
    smooth = spark.createDataFrame([(i * n + j, float(i + j)) for i in range(n) for j in range(n)], "unit_id long, value double")
    return smooth, spark.createDataFrame(edges, "src long, dst long")


def test_permutation_tests(spark):
    smooth, edges = grid(spark)
    row = spatial.moran_global(smooth, edges, permutations=49).first()
    assert row.moran_i > 0.8 and row.p_sim == pytest.approx(1 / 50)
    noise = smooth.withColumn("value", F.pmod(F.xxhash64("unit_id"), F.lit(1000)).cast("double"))
    assert spatial.moran_global(noise, edges, permutations=49).first().p_sim > 0.04
    local = spatial.moran_local(smooth, edges, permutations=49).collect()
    corners = {r.unit_id: r for r in local}
    assert corners[0].significant and corners[0].quadrant == 3
    assert corners[143].significant and corners[143].quadrant == 1


def test_splits_by_hand(spark):
    units = spark.createDataFrame([("a", "C1", 10), ("b", "C1", 30), ("c", "C2", 60), ("d", "C2", 0)], "unit_id string, commune string, population long")
    plans = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 2), (0, "d", 2)], "plan_id int, unit_id string, district int")
    row = integrity.plan_split_metrics(plans, units, "commune").first()
    assert (row.split_units, row.split_severity, row.affected_share, row.split_share, row.small_fragments) == (1, 0.4, 0.4, 0.5, 0)
    assert row.most_split == ["C1"]
    with pytest.raises(Exception, match="positive"):
        integrity.population_feasibility(units.withColumn("population", F.lit(0)).withColumn("unit_id", F.lit(1)), 2, 0.1).collect()
