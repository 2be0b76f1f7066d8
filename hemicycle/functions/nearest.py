"""Nearest-neighbour join by descent through an adaptive quadtree table.

A pyramid of cells holds how many points each cell has, their bounding box and
the smallest rank among them; cells of few points are leaves, crowded ones are
split further. Searches descend level by level: the farthest corner of a box
bounds the answer from above, the nearest one from below, and a cell that
cannot hold the answer is dropped. Only points of the leaves left over are
measured, so neither crowded spots nor far searches form all pairs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from hemicycle.session import cut_lineage

#: points of a leaf at most; finest level, and levels that a step goes down
LEAF, FINEST, STEP = 64, 24, 2


def _tree(points: DataFrame) -> DataFrame:
    """Cells ``level, cx, cy`` with their points' number, box and least rank."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(FINEST), F.lit(STEP)))
    cells = points.withColumn("level", levels).withColumns(
        {c: F.expr(f"shiftright({i}, cast({FINEST} - level as int))") for c, i in (("cx", "ix"), ("cy", "iy"))}
    )
    tree = cells.groupBy("level", "cx", "cy").agg(
        F.count("*").alias("points"), F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"),
        F.min("rank").alias("least"),
    )
    crowded = (F.col("points") > LEAF) & (F.col("level") < FINEST)
    return cut_lineage(tree.withColumn("leaf", ~crowded))


def _index(value: str, low: float, size: float) -> Column:
    cells = 1 << FINEST
    return F.least(F.lit(cells - 1), F.floor((F.col(value) - low) / (size or 1.0) * cells)).cast("long")


def most_barred(exclude: DataFrame | None) -> int:
    """The largest number of forbidden rows of a search."""
    if exclude is None:
        return 0
    return exclude.groupBy("unit_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


class Quadtree(NamedTuple):
    """Points, their cells, and how many points at one spot were kept."""

    points: DataFrame
    cells: DataFrame
    room: int


def quadtree(right: DataFrame, earlier: str | None = None, room: int = 1) -> Quadtree | None:
    """Index of (unit_id, x, y); None without points.

    Of the points at one spot only ``room`` with the smallest ids are kept: a
    search that may not use k of them needs k + 1.
    """
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    rank = F.col(earlier).cast("long") if earlier else F.lit(0).cast("long")
    flat = right.filter(here).select(F.col("unit_id").alias("near_id"), F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry"), rank.alias("rank"))
    box = flat.agg(F.min("rx").alias("x"), F.min("ry").alias("y"), F.max("rx").alias("mx"), F.max("ry").alias("my")).first()
    if box.x is None:
        return None
    size = max(box.mx - box.x, box.my - box.y)
    alike = F.row_number().over(Window.partitionBy("rx", "ry", "rank").orderBy("near_id"))
    flat = flat.withColumn("_r", alike).where(F.col("_r") <= room).drop("_r")
    points = cut_lineage(flat.withColumn("ix", _index("rx", box.x, size)).withColumn("iy", _index("ry", box.y, size)))
    return Quadtree(points, _tree(points), room)


def nearest(
    left: DataFrame, right: DataFrame, exclude: DataFrame | None = None, earlier: str | None = None, group: str | None = None,
    index: Quadtree | None = None,
) -> DataFrame:
    """Nearest right row of each left row: (unit_id, near_id, distance).

    Both sides have unit_id, x, y; a row never matches itself; of equally near
    rows the smallest id counts. ``exclude`` lists forbidden (unit_id, near_id)
    pairs; ``earlier`` names a column whose right value must be smaller. With
    ``group``, a column of left, only rows whose search may hold the nearest
    pair of their group are followed; the others have no row. Rows without
    coordinates take no part. ``index`` is a quadtree of right, if there is one
    with room for two points more than a row's forbidden ones.
    """
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    rank = F.col(earlier).cast("long") if earlier else F.lit(0).cast("long")
    index = index or quadtree(right, earlier, 1 if earlier else 2 + most_barred(exclude))
    if index is None:
        return left.select("unit_id", F.col("unit_id").alias("near_id"), F.lit(0.0).alias("distance")).limit(0)
    points, tree = index.points, index.cells

    seeds = left.filter(here).select(
        "unit_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), rank.alias("mine"), (F.col(group) if group else F.col("unit_id")).alias("party")
    )
    # a cell promises a match only if it holds more points than a search may not use
    if earlier:
        seeds = seeds.withColumn("spare", F.lit(0).cast("long"))
    elif exclude is not None:
        barred = exclude.groupBy("unit_id").agg(F.count("*").alias("_b"))
        seeds = seeds.join(barred, "unit_id", "left").withColumn("spare", 1 + F.coalesce("_b", F.lit(0))).drop("_b")
    else:
        seeds = seeds.withColumn("spare", F.lit(1).cast("long"))

    def gap(low: str, high: str, value: str) -> Column:
        return F.greatest(F.col(low) - F.col(value), F.col(value) - F.col(high), F.lit(0.0))

    def reach(low: str, high: str, value: str) -> Column:
        return F.greatest(F.abs(F.col(value) - F.col(low)), F.abs(F.col(high) - F.col(value)))

    def bounded(pairs: DataFrame) -> DataFrame:
        fit = pairs.where("least < mine") if earlier else pairs
        near, far = F.hypot(gap("x0", "x1", "x"), gap("y0", "y1", "y")), F.hypot(reach("x0", "x1", "x"), reach("y0", "y1", "y"))
        return fit.select(*seeds.columns, "level", "cx", "cy", "leaf", near.alias("near"), F.when(F.col("points") > F.col("spare"), far).alias("far"))

    def pruned(pairs: DataFrame) -> DataFrame:
        best = pairs.groupBy("party").agg(F.min("far").alias("_most"))
        slack = 1 + 1e-9  # rounding never drops the answer
        return pairs.join(best, "party").where(F.col("_most").isNull() | (F.col("near") <= F.col("_most") * slack)).drop("_most")

    top = tree.where("level = 0").drop("level", "cx", "cy").select(F.struct("*").alias("t")).scalar()
    start = seeds.withColumn("_t", top).select(*seeds.columns, F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), "_t.*")
    kept = cut_lineage(pruned(bounded(start)))
    for level in range(STEP, FINEST + 1, STEP):
        inner = kept.where("NOT leaf")
        if inner.isEmpty():
            break
        kids = tree.where(F.col("level") == level).withColumns({"px": F.shiftright("cx", STEP), "py": F.shiftright("cy", STEP)})
        up = inner.select(*seeds.columns, F.col("cx").alias("px"), F.col("cy").alias("py"))
        kept = cut_lineage(pruned(bounded(up.join(kids, ["px", "py"])).unionByName(kept.where("leaf"))))
    spots = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(FINEST), F.lit(STEP)))).withColumns(
        {c: F.expr(f"shiftright({i}, cast({FINEST} - level as int))") for c, i in (("cx", "ix"), ("cy", "iy"))}
    )
    leaves = spots.join(kept.select("level", "cx", "cy").distinct(), ["level", "cx", "cy"], "left_semi").select("level", "cx", "cy", "near_id", "rx", "ry", "rank")
    pairs = kept.select("unit_id", "x", "y", "mine", "level", "cx", "cy").join(leaves, ["level", "cx", "cy"])
    pairs = pairs.where((F.col("rank") < F.col("mine")) if earlier else (F.col("unit_id") != F.col("near_id")))
    if exclude is not None:
        pairs = pairs.join(exclude, ["unit_id", "near_id"], "left_anti")
    distance = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    best = pairs.groupBy("unit_id").agg(F.min(F.struct(distance.alias("distance"), "near_id")).alias("b"))
    return best.select("unit_id", "b.near_id", "b.distance")
