"""Polygon measures over a vertex table.

Vertices are ``(unit_id, part, ring, seq, x, y)``: rings are closed (the last
vertex repeats the first), ring 0 of a part is its outline, others are holes,
and ``seq`` counts up by one. Segments come from an equi-join on the next
``seq``, so even one enormous ring is spread over all tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hemicycle.functions.frames import attach, ratio, rnd, shuffled, sized, small_side
from hemicycle.session import cut_lineage

# executors get these small helpers with the task, without an installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RING = ["unit_id", "part", "ring"]
_HULL_CHUNK = 10_000
_POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"])


def segments(vertices: DataFrame) -> DataFrame:
    """Directed segments (x, y) -> (x2, y2) with a canonical key (a, b)."""
    following = vertices.select(*RING, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = vertices.select(*RING, "seq", "x", "y").join(shuffled(following), [*RING, "seq"]).where("x <> x2 OR y <> y2")
    forward = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") <= F.col("y2")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return pairs.withColumns(
        {"ax": pick("x", "x2"), "ay": pick("y", "y2"), "bx": pick("x2", "x"), "by": pick("y2", "y"),
         "length": F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))}
    )


def _rings(vertices: DataFrame) -> DataFrame:
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = segments(vertices).groupBy(*RING).agg(
        (F.sum(cross) / 2).alias("_a"), F.sum("length").alias("_len"),
        (F.sum((F.col("x") + F.col("x2")) * cross) / 6).alias("_mx"),
        (F.sum((F.col("y") + F.col("y2")) * cross) / 6).alias("_my"),
    )
    turn = F.when(F.col("_a") < 0, -1).otherwise(1) * F.when(F.col("ring") == 0, 1).otherwise(-1)
    return sums.withColumns({c: F.col(c) * turn for c in ("_a", "_mx", "_my")})


def area_perimeter(vertices: DataFrame) -> DataFrame:
    """Area without holes and the length of all rings."""
    return _rings(vertices).groupBy("unit_id").agg(F.sum("_a").alias("area"), F.sum("_len").alias("perimeter"))


def centroid(vertices: DataFrame) -> DataFrame:
    moved = _rings(vertices).groupBy("unit_id").agg(F.sum("_a").alias("_a"), F.sum("_mx").alias("_mx"), F.sum("_my").alias("_my"))
    return moved.select("unit_id", (F.col("_mx") / F.col("_a")).alias("x"), (F.col("_my") / F.col("_a")).alias("y"))


def polsby_popper(area: Column, perimeter: Column) -> Column:
    return ratio(4 * math.pi * area, perimeter * perimeter)


def schwartzberg(area: Column, perimeter: Column) -> Column:
    return ratio(2 * math.pi * F.sqrt(area / math.pi), perimeter)


def shared_borders(vertices: DataFrame) -> DataFrame:
    """Common border length of adjacent units (src < dst), once per pair."""
    sides = segments(vertices).select("unit_id", "ax", "ay", "bx", "by", "length").distinct()
    left, right = sides.withColumnRenamed("unit_id", "src"), sides.drop("length").withColumnRenamed("unit_id", "dst")
    return left.join(shuffled(right), ["ax", "ay", "bx", "by"]).where("src < dst").groupBy("src", "dst").agg(F.sum("length").alias("border"))


def spatial_summary(vertices: DataFrame, units: DataFrame, group: str | None = None) -> DataFrame:
    """Area, perimeter, compactness and density per unit or group, 3 digits."""
    base = area_perimeter(vertices).join(units, "unit_id")
    km2, km = F.col("area") / 1e6, F.col("perimeter") / 1e3
    full = base.withColumns(
        {"area_km2": km2, "perimeter_km": km,
         "polsby_popper": polsby_popper(F.col("area"), F.col("perimeter")),
         "schwartzberg": schwartzberg(F.col("area"), F.col("perimeter")),
         "density": ratio(F.col("population"), km2)}
    )
    cols = ["area_km2", "perimeter_km", "polsby_popper", "schwartzberg", "density"]
    if group is None:
        return full.select("unit_id", "population", *[rnd(c, 3).alias(c) for c in cols])
    return full.groupBy(group).agg(
        rnd(F.sum("area_km2"), 3).alias("area_km2"), F.sum("population").alias("population"),
        *[rnd(F.avg(c), 3).alias(c) for c in ("polsby_popper", "schwartzberg", "density")],
    )


def _hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull in turning order."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ordered):
        chain: list = []
        for p in ordered:
            while len(chain) > 1:
                a, c = chain[-2], chain[-1]
                if (c[0] - a[0]) * (p[1] - a[1]) - (c[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


@F.pandas_udf(T.ArrayType(_POINT))
def _hull_of_points(points: pd.Series) -> pd.Series:
    """Convex hull of the points of each row."""
    return points.map(lambda row: [
        {"x": x, "y": y} for x, y in _hull(np.array([(p["x"], p["y"]) for p in row], float)).tolist()
    ])


def hulls(vertices: DataFrame) -> DataFrame:
    """Convex hull (unit_id, hull array) of each unit.

    Long outlines are first cut to the hulls of pieces of bounded length, so
    the last step of a unit only sees points that may lie on its hull.
    """
    points = lambda: F.collect_list(F.struct("x", "y"))
    piece = F.floor(F.col("seq") / _HULL_CHUNK)
    pieces = vertices.where("ring = 0").groupBy("unit_id", "part", piece.alias("_piece")).agg(points().alias("_p"))
    corners = pieces.select("unit_id", F.inline(_hull_of_points("_p")))
    whole = corners.groupBy("unit_id").agg(points().alias("_p"))
    return whole.select("unit_id", _hull_of_points("_p").alias("hull"))


def hull_points(hull: DataFrame) -> DataFrame:
    return hull.select("unit_id", F.inline("hull"))


def hull_area(hull: DataFrame) -> DataFrame:
    """Area of each hull; the outline is closed by its first point."""
    h = F.col("hull")
    following = F.concat(F.slice(h, 2, F.size(h)), F.slice(h, 1, 1))
    cross = F.zip_with(h, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return hull.select("unit_id", (F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2).alias("hull_area"))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyr"]))
def _circle_of_few(points: pd.Series) -> pd.DataFrame:
    """Smallest circle around at most four points per row."""
    full = np.array([[(p["x"], p["y"]) for p in row] + [(row[0]["x"], row[0]["y"])] * (4 - len(row)) for row in points], float)
    full = full.reshape(len(points), 4, 2)
    base = full[:, :1, :]
    local = full - base
    best = np.full((len(points), 3), np.inf)

    def offer(center, radius):
        reach = np.hypot(local[:, :, 0] - center[:, None, 0], local[:, :, 1] - center[:, None, 1]).max(axis=1)
        better = np.isfinite(radius) & (reach <= radius * (1 + 1e-9) + 1e-12) & (radius < best[:, 2])
        best[better] = np.column_stack([center, radius])[better]

    for i in range(4):
        for j in range(i + 1, 4):
            middle = (local[:, i] + local[:, j]) / 2
            offer(middle, np.hypot(*(local[:, i] - local[:, j]).T) / 2)
            for k in range(j + 1, 4):
                a, c = local[:, j] - local[:, i], local[:, k] - local[:, i]
                with np.errstate(all="ignore"):
                    d = 2 * (a[:, 0] * c[:, 1] - a[:, 1] * c[:, 0])
                    qa, qc = (a**2).sum(axis=1), (c**2).sum(axis=1)
                    u = np.column_stack([(c[:, 1] * qa - a[:, 1] * qc) / d, (a[:, 0] * qc - c[:, 0] * qa) / d])
                    offer(local[:, i] + u, np.hypot(u[:, 0], u[:, 1]))
    return pd.DataFrame({"x": best[:, 0] + base[:, 0, 0], "y": best[:, 1] + base[:, 0, 1], "r": best[:, 2]})


def enclosing_circles(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest enclosing circle per group: (keys, cx, cy, r).

    Each round finds the farthest point of every group (an aggregation with
    map-side combine) and solves a circle for the points on the current one
    plus that point, at most four. Radii only grow, so it ends with a circle
    that holds all points, without gathering a group anywhere.
    """
    keys = list(keys)
    p = F.struct("x", "y")
    start = points.groupBy(*keys).agg(
        F.min_by(p, F.struct("x", "y")).alias("a"), F.max_by(p, F.struct("x", "y")).alias("b"),
        F.min_by(p, F.struct("y", "x")).alias("c"), F.max_by(p, F.struct("y", "x")).alias("d"),
    )

    def solved(frame: DataFrame, few: Column) -> DataFrame:
        held = frame.withColumn("_few", F.array_distinct(few)).withColumn("_c", _circle_of_few("_few"))
        rim = F.filter("_few", lambda q: F.hypot(q["x"] - F.col("_c.x"), q["y"] - F.col("_c.y")) >= F.col("_c.r") * (1 - 1e-9))
        return held.select(*keys, F.slice(rim, 1, 3).alias("basis"), F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"), F.col("_c.r").alias("r"))

    circles = cut_lineage(solved(start, F.array("a", "b", "c", "d")))
    while True:
        away = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
        outside = points.join(sized(circles), keys).where(away > F.col("r") * (1 + 1e-9) + 1e-12)
        worst = outside.groupBy(*keys).agg(F.max(F.struct(away.alias("far"), "x", "y")).alias("_w"))
        worst = cut_lineage(worst.select(*keys, F.struct("_w.x", "_w.y").alias("_w")))
        if worst.isEmpty():
            return circles.drop("basis")
        worst = sized(worst)
        grown = solved(circles.join(worst, keys), F.concat("basis", F.array("_w")))
        circles = cut_lineage(circles.join(worst, keys, "left_anti").unionByName(grown))


def compactness(vertices: DataFrame) -> DataFrame:
    """Polsby-Popper, Schwartzberg, hull ratio, Reock and their mean."""
    hull = cut_lineage(hulls(vertices))
    circles = enclosing_circles(hull_points(hull), ["unit_id"])
    out = area_perimeter(vertices).join(shuffled(hull_area(hull)), "unit_id").join(shuffled(circles.select("unit_id", "r")), "unit_id")
    out = out.select(
        "unit_id",
        polsby_popper(F.col("area"), F.col("perimeter")).alias("polsby_popper"),
        schwartzberg(F.col("area"), F.col("perimeter")).alias("schwartzberg"),
        ratio(F.col("area"), F.col("hull_area")).alias("convex_hull_ratio"),
        ratio(F.col("area"), math.pi * F.col("r") * F.col("r")).alias("reock"),
    )
    four = ["polsby_popper", "schwartzberg", "convex_hull_ratio", "reock"]
    return out.withColumn("mean_compactness", sum(F.col(c) for c in four) / 4)


def reock_by_plan(plans: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean Reock of the districts of each plan; fails outside [0, 1]."""
    corners = hull_points(cut_lineage(hulls(vertices)))
    areas = small_side(area_perimeter(vertices).select("unit_id", "area"))
    points = plans.join(sized(corners), "unit_id").select("plan_id", "district", "x", "y")
    circles = enclosing_circles(points, ["plan_id", "district"])
    area = plans.join(areas, "unit_id").groupBy("plan_id", "district").agg(F.sum("area").alias("area"))
    value = F.col("area") / (math.pi * F.col("r") * F.col("r"))
    checked = F.when(value.between(0, 1 + 1e-9), value).otherwise(F.raise_error(F.lit("Reock outside [0, 1]")))
    return area.join(circles, ["plan_id", "district"]).where("r > 0").groupBy("plan_id").agg(F.avg(checked).alias("reock_mean"))


# fixed values: WGS 84 ellipsoid and UTM scale
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm_zone(points: DataFrame) -> DataFrame:
    """Zone of the middle of the bounding box and its EPSG code."""
    middle = (F.min("lon") + F.max("lon")) / 2
    zone = (F.floor((middle + 180) / 6) + 1).cast("int")
    south = (F.min("lat") + F.max("lat")) / 2 < 0
    return points.agg(zone.alias("zone"), (F.when(south, 32700).otherwise(32600) + zone).alias("epsg"))


def project_utm(points: DataFrame) -> DataFrame:
    """Add easting ``x`` and northing ``y`` (metres) in the common UTM zone,
    by the usual transverse Mercator series."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = math.sqrt(_F * (2 - _F))
    lat, turn = F.radians("lat"), F.radians(F.col("lon") - (F.col("zone") * 6 - 183))
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    away = F.when(F.col("epsg") > 32700, 10_000_000.0).otherwise(0.0)
    return attach(points, utm_zone(points)).withColumns(
        {"x": 500_000 + _K0 * radius * east, "y": away + _K0 * radius * north}
    )
