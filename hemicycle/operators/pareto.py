"""Non-dominated points, trade-off fronts and their knee."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach, ratio, rnd, sized
from hemicycle.functions.ordered import exact_quantiles, row_index, running
from hemicycle.functions.stats import clean, to_long
from hemicycle.session import cut_lineage

#: points of a chunk, and numbers of one comparison
_BLOCK, _TILE = 4096, 1 << 24


def _oriented(col: str, smaller_is_better: bool) -> Column:
    return clean(col) if smaller_is_better else -clean(col)


def front_2d(points: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct non-dominated (x, y) per key, both to be minimised.

    Per x only the smallest y can stay, and only if it beats the smallest y
    of every smaller x: one aggregation and one running minimum.
    """
    best = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.min(y).alias(y))
    scanned = running(best, keys, [x], {"_earlier": ("min", y)}, exclusive=True)
    return scanned.where(F.col("_earlier").isNull() | (F.col("_earlier") > F.col(y))).select(*keys, x, y)


def _undominated(points: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which points no rival dominates; compared in tiles."""
    keep = np.ones(len(points), bool)
    step = max(1, _TILE // max(1, len(rivals) * points.shape[1]))
    for begin in range(0, len(points), step):
        p = points[begin : begin + step, None, :]
        keep[begin : begin + step] = ~((rivals <= p).all(axis=2) & (rivals < p).any(axis=2)).any(axis=1)
    return keep


def _local_front(dims: Sequence[str], block: int):
    """Non-dominated points of each slice of ``block`` rows, against the slice's earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, len(dims)))
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in dims]).astype(float)
            for begin in range(0, len(rows), block):
                part = rows[begin : begin + block]
                part = part[_undominated(part, best)]
                part = part[_undominated(part, part)]
                best = np.concatenate([best, part])[:block]  # the smallest sums come first and strike most
                yield pa.RecordBatch.from_arrays([pa.array(part[:, i]) for i in range(len(dims))], names=list(dims))

    return run


def _beaten(dims: Sequence[str]):
    """Points of a chunk that some point of another chunk dominates."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.column_stack([table.column(c).to_numpy() for c in dims]).astype(float)
        rival = table.column("rival").to_numpy(zero_copy_only=False)
        lost = rows[~rival][~_undominated(rows[~rival], rows[rival])]
        return pa.table({c: lost[:, i] for i, c in enumerate(dims)})

    return run


def front_nd(points: DataFrame, dims: Sequence[str], block: int = _BLOCK) -> DataFrame:
    """Distinct non-dominated points in any number of dimensions (minimised).

    The ``block`` points with the smallest sums are sent ahead and strike out
    what they dominate. The rest is put in the order of sums, each partition
    keeps its own front, and then chunks of ``block`` survivors meet: a point
    can only be dominated by one with a smaller or equal sum, so a chunk meets
    those before it. All chunks meet in one job; no task holds more than two.
    """
    kinds = ", ".join(f"`{d}` double" for d in dims)
    total = sum((F.col(d) for d in dims[1:]), F.col(dims[0]))
    wide = points.select(*[F.col(d).cast("double").alias(d) for d in dims]).dropna().distinct()
    waiting = cut_lineage(wide.withColumn("_sum", total))
    head = waiting.orderBy("_sum", *dims).limit(block).select(*dims).collect()  # ``block`` rows
    if not head:
        return wide
    ahead = np.array([tuple(r) for r in head], float)
    ahead = ahead[_undominated(ahead, ahead)]

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in dims]).astype(float)
            rows = rows[_undominated(rows, ahead)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(len(dims))], names=list(dims))

    left = waiting.select(*dims).mapInArrow(strike, kinds).withColumn("_sum", total)
    slices = left.repartitionByRange("_sum", *dims).sortWithinPartitions("_sum", *dims).select(*dims)
    local = cut_lineage(slices.mapInArrow(_local_front(dims, block), kinds))
    placed = row_index(local.withColumn("_sum", total), (), ["_sum", *dims], "_at").withColumn("_chunk", F.expr(f"_at div {block}"))
    placed = cut_lineage(placed.select(*dims, "_chunk"))
    last = placed.agg(F.max("_chunk")).first()[0]
    if not last:
        return _alone(placed, dims, kinds)
    meets = F.explode(F.sequence(F.col("_chunk"), F.lit(last)))
    own = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunk")))
    rivals = placed.select(*dims, F.col("_chunk").alias("_q"), meets.alias("_p"), F.lit(True).alias("rival"))
    victims = placed.select(*dims, own.alias("_q"), F.col("_chunk").alias("_p"), F.lit(False).alias("rival"))
    lost = rivals.unionByName(victims).groupBy("_p", "_q").applyInArrow(_beaten(dims), kinds)
    return placed.select(*dims).join(lost.distinct(), list(dims), "left_anti")


def _alone(placed: DataFrame, dims: Sequence[str], kinds: str) -> DataFrame:
    """The front of a single chunk."""
    both = placed.select(*dims, F.lit(True).alias("rival")).unionByName(placed.select(*dims, F.lit(False).alias("rival")))
    lost = both.groupBy(F.lit(0).alias("_p")).applyInArrow(_beaten(dims), kinds)
    return placed.select(*dims).join(lost.distinct(), list(dims), "left_anti")


def pareto(points: DataFrame, minimise: dict[str, bool], missing: bool = True) -> DataFrame:
    """Add ``is_pareto``: no other point is at least as good on all named
    columns and better on one. Equal points stay together; a point with a
    missing coordinate is never dominated and counts as ``missing``."""
    names = [f"_d{i}" for i in range(len(minimise))]
    placed = points.withColumns({n: _oriented(c, up) for n, (c, up) in zip(names, minimise.items())})
    front = front_2d(placed, *names) if len(names) == 2 else front_nd(placed, names)
    marked = placed.join(front.withColumn("_hit", F.lit(True)), names, "left")
    partial = F.greatest(*[F.col(n).isNull() for n in names])
    flag = F.when(partial, F.lit(missing)).otherwise(F.coalesce("_hit", F.lit(False)))
    return marked.withColumn("is_pareto", flag).select(*points.columns, "is_pareto")


def tradeoff_frontier(plans: DataFrame, x: str, y: str, minimise_x: bool = True, minimise_y: bool = True) -> DataFrame:
    """All plans with ``is_pareto`` on two metrics; needs two valid plans."""
    flagged = pareto(plans, {x: minimise_x, y: minimise_y}, missing=False)
    valid = plans.agg(F.count_if(clean(x).isNotNull() & clean(y).isNotNull()).alias("_valid"))
    return attach(flagged, valid).withColumn("is_pareto", F.col("is_pareto") & (F.col("_valid") >= 2)).drop("_valid")


def frontier_metadata(flagged: DataFrame, x: str, y: str) -> DataFrame:
    return flagged.agg(
        F.count_if(clean(x).isNotNull() & clean(y).isNotNull()).alias("n_plans"),
        F.count_if("is_pareto").alias("n_pareto"),
    )


def penalty_stats(plans: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count, mean, sd and quantiles of every metric per penalty."""
    long = to_long(plans, ["penalty"], metrics)
    keys = ["penalty", "metric"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    marks = exact_quantiles(long, keys, "value", {"p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95})
    return attach(moments, marks, keys)


def sweep(ensembles: dict[float, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """Ensembles by penalty stacked, keeping the metrics each one has."""
    out = None
    for penalty, frame in ensembles.items():
        part = frame.select(*[m for m in metrics if m in frame.columns], F.lit(float(penalty)).alias("penalty"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: parts of the points whose own fronts are the witnesses of a resampling
_WITNESSES = 16


def _may_lead(placed: DataFrame, drawn, replicates: int) -> DataFrame:
    """The rows of ``placed`` that may be on the front of some replicate.

    The fronts of a few parts of the points lie close to any resampled front.
    Those of their points that a replicate draws bound its front: a point is
    left out only if every replicate draws one that is smaller in x and not
    larger in y. That bound falls with x, so a running minimum finds it.
    """
    part = F.pmod(F.xxhash64("penalty", "_pos"), F.lit(_WITNESSES)).alias("_part")
    fronts = front_2d(placed.select("x", "y", part), "x", "y", ["_part"])
    steps = cut_lineage(fronts.select("x", "y").distinct())
    seen = drawn(placed.join(sized(steps), ["x", "y"], "left_semi")).groupBy("replicate", "x").agg(F.min("y").alias("y"))
    every = steps.select("x").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    best = running(every.join(seen, ["replicate", "x"], "left"), ["replicate"], ["x"], {"_best": ("min", "y")})
    bound = best.groupBy("x").agg(F.when(F.count("_best") == replicates, F.max("_best")).alias("_bound"))
    lines = placed.select("penalty", "_pos", "x", "y", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_bound")).unionByName(
        bound.select("x", F.lit(1).alias("_kind"), "_bound"), allowMissingColumns=True)
    met = running(lines, (), ["x", "_kind", "penalty", "_pos"], {"_least": ("min", "_bound")}, exclusive=True)
    return met.where((F.col("_kind") == 0) & (F.col("_least").isNull() | (F.col("y") < F.col("_least"))))


def bootstrap_bands(
    plans: DataFrame, x: str, y: str, replicates: int = 200, points: int = 60, seed: int = 0
) -> DataFrame:
    """5-95 % bands of the front under resampling within each penalty.

    Draw j of a replicate takes the plan at a hashed position of its penalty
    group, so a replicate is just another key. Draws that cannot be on a front
    are left out where they are made. Every front segment writes the
    grid points it covers; both ends continue flat. Both metrics are
    minimised. Empty below four plans or ten usable replicates.
    """
    valid = plans.select("penalty", clean(x).alias("x"), clean(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    full = front_2d(valid, "x", "y")
    grid = full.agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.count(F.lit(1)).alias("_front"))
    placed = row_index(valid, ["penalty"], ["x", "y"], "_pos")
    sizes = placed.groupBy("penalty").agg(F.count(F.lit(1)).alias("_m"))
    placed = cut_lineage(attach(placed, sizes, ["penalty"]).where("_m >= 2"))
    draws = placed.select("penalty", "_pos", "_m", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    hit = F.pmod(F.xxhash64(F.lit(seed), "replicate", "penalty", "_pos"), F.col("_m"))
    draws = draws.select("penalty", "replicate", hit.alias("_pos"))
    drawn = lambda some: draws.join(sized(some.select("penalty", "_pos", "x", "y")), ["penalty", "_pos"]).distinct()
    near = cut_lineage(_may_lead(placed, drawn, replicates))
    drawn = drawn(near).select("replicate", "x", "y")
    fronts = row_index(front_2d(drawn, "x", "y", ["replicate"]), ["replicate"], ["x"], "_i")
    following = fronts.select("replicate", (F.col("_i") - 1).alias("_i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    segments = fronts.join(following, ["replicate", "_i"])
    counts = fronts.groupBy("replicate").agg(F.max("_i").alias("_last"))
    segments = attach(attach(segments, counts, ["replicate"]), grid).where("_last >= 1 AND _front >= 2 AND _a < _b")
    step = (F.col("_b") - F.col("_a")) / (points - 1)
    first = F.when(F.col("_i") == 0, 0).otherwise(F.ceil((F.col("x") - F.col("_a")) / step))
    after = F.when(F.col("_i") == F.col("_last") - 1, points).otherwise(F.ceil((F.col("x2") - F.col("_a")) / step))
    first, after = F.greatest(first, F.lit(0)), F.least(after, F.lit(points))
    covered = segments.where(first < after).withColumn("grid", F.explode(F.sequence(first, after - 1)))
    spot = F.col("_a") + F.col("grid") * step
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (spot - F.col("x")) / (F.col("x2") - F.col("x"))))
    lines = covered.select("replicate", "grid", spot.alias("x_grid"), (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("_y"))
    lines = cut_lineage(lines)
    usable = lines.agg(F.count_distinct("replicate").alias("_reps"))
    enough = valid.agg(F.count(F.lit(1)).alias("_n"))
    probs = {"y_p5": 0.05, "y_p25": 0.25, "y_p50": 0.5, "y_p75": 0.75, "y_p95": 0.95}
    bands = exact_quantiles(lines, ["grid", "x_grid"], "_y", probs)
    return attach(attach(bands, usable), enough).where("_reps >= 10 AND _n >= 4").drop("_reps", "_n")


def frontier_distances(front: DataFrame, x: str, y: str, normalised: bool = True, diminishing: float = 0.5) -> DataFrame:
    """Front points in x order with their distance to the end-to-end chord
    and whether the gain per unit of x has fallen below ``diminishing`` times
    the mean positive gain."""
    points = row_index(front.where(clean(x).isNotNull() & clean(y).isNotNull()).withColumns({"_x": clean(x), "_y": clean(y)}),
                       (), ["_x", "_y", *[c for c in ("penalty",) if c in front.columns]], "position")
    points = cut_lineage(points)
    ends = points.agg(
        F.min("_x").alias("_xa"), F.max("_x").alias("_xb"), F.min("_y").alias("_ya"), F.max("_y").alias("_yb"),
        F.min_by("_y", "position").alias("_first"), F.max_by("_y", "position").alias("_last"),
    )
    base = attach(points, ends)
    if normalised:
        scale = lambda v, a, b: F.when(F.col(b) - F.col(a) > 1e-12, (v - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    else:
        scale = lambda v, a, b: v
    sx, sy = (lambda v: scale(v, "_xa", "_xb")), (lambda v: scale(v, "_ya", "_yb"))
    x0, x1, y0, y1 = sx(F.col("_xa")), sx(F.col("_xb")), sy(F.col("_first")), sy(F.col("_last"))
    chord = F.hypot(x1 - x0, y1 - y0)
    raw = F.abs((y1 - y0) * sx(F.col("_x")) - (x1 - x0) * sy(F.col("_y")) + x1 * y0 - y1 * x0)
    base = base.withColumn("distance", F.when(chord < 1e-12, 0.0).otherwise(raw / chord))
    previous = points.select((F.col("position") + 1).alias("position"), F.col("_x").alias("_px"), F.col("_y").alias("_py"))
    base = base.join(previous, "position", "left")
    dx = F.col("_x") - F.col("_px")
    base = base.withColumn("_rate", F.when(dx > 1e-12, -(F.col("_y") - F.col("_py")) / dx))
    mean = base.agg(F.avg(F.when(F.col("_rate") > 0, F.col("_rate"))).alias("_mean_rate"))
    falling = F.coalesce(F.col("_rate") < diminishing * F.col("_mean_rate"), F.lit(False))
    out = attach(base, mean).withColumn("diminishing", falling)
    return out.select(*front.columns, "position", "distance", "diminishing")


def knee_point(front: DataFrame, x: str, y: str, normalised: bool = True, diminishing: float = 0.5) -> DataFrame:
    """One row: the farthest point from the chord, first on ties."""
    points = frontier_distances(front, x, y, normalised, diminishing)
    best = F.min_by(
        F.struct("position", F.col(x).alias("kx"), F.col(y).alias("ky"), *[F.col(c) for c in ("penalty",) if c in front.columns]),
        F.struct(-F.col("distance"), "position"),
    )
    out = points.agg(best.alias("k"), F.min(F.when(F.col("diminishing"), F.col(x))).alias("diminishing_start_x"))
    extra = [F.col("k.penalty").alias("knee_penalty")] if "penalty" in front.columns else []
    return out.select(F.col("k.position").alias("knee_index"), F.col("k.kx").alias("knee_x"), F.col("k.ky").alias("knee_y"), *extra, "diminishing_start_x")


def summarize_tradeoff(flagged: DataFrame, metrics: Sequence[str], knee: DataFrame) -> DataFrame:
    """Per penalty: plans, metric statistics, Pareto share, knee flag.

    ``flagged`` comes from the frontier, ``knee`` from the knee point; the
    knee sits at its exact penalty, or at the nearest one.
    """
    stats = penalty_stats(flagged, metrics)
    wide = stats.groupBy("penalty").agg(*[
        F.max(F.when(F.col("metric") == m, rnd(c, 6))).alias(f"{m}_{c}")
        for m in metrics for c in ("mean", "std", "p5", "p95")
    ])
    counts = flagged.groupBy("penalty").agg(
        F.count(F.lit(1)).alias("n_plans"), F.count_if("is_pareto").alias("n_pareto")
    ).withColumn("pct_pareto", rnd(F.col("n_pareto") / F.col("n_plans") * 100, 1))
    nearest = attach(counts, knee.select("knee_penalty")).agg(
        F.min_by("penalty", F.struct(F.abs(F.col("penalty") - F.col("knee_penalty")), "penalty")).alias("_knee")
    )
    out = attach(counts.join(wide, "penalty"), nearest)
    return out.withColumn("is_knee", F.coalesce(F.col("penalty") == F.col("_knee"), F.lit(False))).drop("_knee")
