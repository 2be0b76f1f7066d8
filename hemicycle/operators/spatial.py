"""Spatial autocorrelation over an edge table, keyed by any columns.

``values`` is (keys, unit_id, value); ``edges`` is (src, dst). Weights are
row-standardised contiguity unless said otherwise. Permutation p-values keep
all draws of a row in one array (``operators/permutation.py``); no task ever
holds all units.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach, ratio
from hemicycle.functions.probability import normal_tail
from hemicycle.operators.graph import both_ways
from hemicycle.operators.permutation import cross_products, local_counts, placed, pseudo_p, single_layer, spread
from hemicycle.session import cut_lineage


def _neighbours(edges: DataFrame) -> DataFrame:
    """Directed neighbour pairs with the number of neighbours of ``src``."""
    ways = both_ways(edges)
    return attach(ways, ways.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), ["src"])


def spatial_lag(values: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean value of the neighbours of each unit."""
    met = both_ways(edges).join(values.select(*keys, F.col("unit_id").alias("dst"), "value"), "dst")
    return met.groupBy(*keys, F.col("src").alias("unit_id")).agg(F.avg("value").alias("lag"))


def _centred(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    means = values.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.count("value").alias("n"))
    z = attach(values, means, keys).withColumn("z", F.col("value") - F.col("_mean"))
    squares = z.groupBy(*keys).agg(F.sum(F.col("z") * F.col("z")).alias("z2"))
    return attach(z, squares, keys)


def moran_global(values: DataFrame, edges: DataFrame, keys: Sequence[str] = (), permutations: int = 0) -> DataFrame:
    """Moran's I per key with its normal z and, on request, a pseudo p.

    The pseudo p is (1 + the smaller tail count) / (permutations + 1).
    """
    keys = list(keys)
    edges = cut_lineage(edges.select("src", "dst"))
    z = _centred(values, keys)
    lag = spatial_lag(z.select(*keys, "unit_id", F.col("z").alias("value")), edges, keys)
    both = attach(z, lag, [*keys, "unit_id"])
    linked = F.col("lag").isNotNull()
    core = both.groupBy(*keys).agg(
        F.max("n").alias("n"), F.count_if(linked).alias("s0"), F.max("z2").alias("z2"),
        F.sum(F.col("z") * F.col("lag")).alias("_cross"),
    )
    core = core.withColumn("moran_i", F.col("n") / F.col("s0") * F.col("_cross") / F.col("z2"))
    present = values.select(*keys, F.col("unit_id").alias("src"))
    pairs = _neighbours(edges)
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("degree").alias("_back"))
    sums = pairs.join(back, ["src", "dst"]).join(present, "src")
    both_weights = 1 / F.col("degree") + 1 / F.col("_back")
    s1 = sums.groupBy(*keys).agg((F.sum(both_weights * both_weights) / 2).alias("s1"))
    column = sums.groupBy(*keys, "src").agg((1 + F.sum(1 / F.col("_back"))).alias("_t"))
    s2 = column.groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t")).alias("s2"))
    out = attach(attach(core, s1, keys), s2, keys)
    n, s0 = F.col("n").cast("double"), F.col("s0").cast("double")
    expected = -1 / (n - 1)
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected * expected
    out = out.select(*keys, "n", "moran_i", ((F.col("moran_i") - expected) / F.sqrt(variance)).alias("z_norm"))
    if not permutations:
        return out
    where = _members(values, keys)
    drawn = cross_products(single_layer(both_ways(edges), where, keys), where, keys, permutations)
    return attach(out, drawn.select(*keys, pseudo_p(F.col("larger"), permutations).alias("p_sim")), keys)


def _members(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    return placed(values.select(*keys, "unit_id", F.array(F.col("value").cast("double")).alias("y")), keys)


def _local(values: DataFrame, edges: DataFrame, keys: Sequence[str], permutations: int) -> DataFrame:
    where = _members(values, keys)
    return local_counts(where, both_ways(edges), spread(where, keys, 1), keys, permutations, 1)


def moran_local(values: DataFrame, edges: DataFrame, keys: Sequence[str] = (), permutations: int = 0) -> DataFrame:
    """Local Moran per unit: I, quadrant (1 HH, 2 LH, 3 LL, 4 HL) and, on
    request, a conditional pseudo p: the unit stays, its neighbours are drawn
    from all others. A unit without neighbours has no p and is not significant."""
    keys = list(keys)
    z = _centred(values, keys)
    lag = spatial_lag(z.select(*keys, "unit_id", F.col("z").alias("value")), edges, keys)
    both = attach(z, lag, [*keys, "unit_id"]).withColumn("lag", F.coalesce("lag", F.lit(0.0)))
    high, near_high = F.col("z") > 0, F.col("lag") > 0
    quadrant = F.when(high & near_high, 1).when(~high & near_high, 2).when(~high & ~near_high, 3).otherwise(4)
    scale = (F.col("n") - 1) / F.col("z2")
    out = both.select(*keys, "unit_id", "value", (scale * F.col("z") * F.col("lag")).alias("local_i"), quadrant.alias("quadrant"))
    if not permutations:
        return out
    p = pseudo_p(F.col("high")[0], permutations)
    marked = attach(out, _local(values, edges, keys, permutations).select(*keys, "unit_id", p.alias("p_sim")), [*keys, "unit_id"])
    return marked.withColumn("significant", F.coalesce(F.col("p_sim") < 0.05, F.lit(False)))


def _getis(y: Column, near: Column, w: Column, n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Local G with binary weights, the unit itself left out, and its z."""
    others, rest = n - 1, total - y
    mean = rest / others
    variance = (squares - y * y) / others - mean * mean
    width = F.try_divide(F.sqrt(F.try_divide(w * (others - w) * variance, others * others * (n - 2))), mean)
    g = ratio(near, rest)
    return g, F.try_divide(g - w / others, width)


def _spot(z: Column, p: Column) -> Column:
    return F.when((z > 1.96) & (p < 0.05), "hot").when((z < -1.96) & (p < 0.05), "cold").otherwise("none")


def getis_ord_local(values: DataFrame, edges: DataFrame, keys: Sequence[str] = (), permutations: int = 0) -> DataFrame:
    """Local G per unit with neighbours: g, z, normal p and hot or cold spots.

    On request a conditional pseudo p decides about the spots.
    """
    keys = list(keys)
    x = F.col("value").cast("double")
    totals = values.groupBy(*keys).agg(F.count("value").alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    near = both_ways(edges).join(values.select(*keys, F.col("unit_id").alias("dst"), "value"), "dst").groupBy(
        *keys, F.col("src").alias("unit_id")
    ).agg(F.sum("value").alias("_near"), F.count(F.lit(1)).alias("_w"))
    base = attach(values, totals, keys).join(near, [*keys, "unit_id"])
    g, z = _getis(x, F.col("_near"), F.col("_w"), F.col("_n"), F.col("_s"), F.col("_q"))
    p = normal_tail(z)
    if not permutations:
        return base.select(*keys, "unit_id", g.alias("g"), z.alias("z"), p.alias("p_norm"), _spot(z, p).alias("spot"))
    out = base.select(*keys, "unit_id", g.alias("g"), z.alias("z"), p.alias("p_norm"))
    drawn = _local(values, edges, keys, permutations).select(*keys, "unit_id", pseudo_p(F.col("more")[0], permutations).alias("p_sim"))
    return out.join(drawn, [*keys, "unit_id"], "left").withColumn("spot", _spot(F.col("z"), F.col("p_sim")))


def rings(edges: DataFrame, where: DataFrame, max_order: int) -> DataFrame:
    """Relation of units exactly k hops apart, one layer an order.

    All units search at once: a row holds the searches of 64 units as one
    number, so a step is an OR over the neighbours without the bits seen.
    """
    spot = where.select(F.col("unit_id").alias("src"), F.col("pos").alias("_i"))
    ways = both_ways(edges).distinct().join(spot, "src").join(spot.select(F.col("src").alias("dst"), F.col("_i").alias("_j")), "dst")
    ways = cut_lineage(ways.select(F.col("_i").alias("node"), F.col("_j").alias("to")))
    start = where.select(F.expr("pos div 64").alias("group"), F.col("pos").alias("node"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bits"))
    front = seen = cut_lineage(start)
    out = None
    for order in range(1, max_order + 1):
        step = front.join(ways, "node").groupBy("group", F.col("to").alias("node")).agg(F.bit_or("bits").alias("bits"))
        fresh = step.join(seen.withColumnRenamed("bits", "_old"), ["group", "node"], "left")
        fresh = fresh.select("group", "node", F.expr("bits & ~coalesce(_old, 0)").alias("bits")).where("bits <> 0")
        front = cut_lineage(fresh)
        part = front.select(F.lit(order).alias("layer"), "group", "node", "bits")
        out = part if out is None else out.unionByName(part)
        if order < max_order:
            seen = cut_lineage(seen.unionByName(front).groupBy("group", "node").agg(F.bit_or("bits").alias("bits")))
    return out


def spatial_correlogram(
    values: DataFrame, edges: DataFrame, max_order: int = 7, permutations: int = 199
) -> DataFrame:
    """Moran's I among units exactly k hops apart, for each order k that occurs.

    ``p_sim`` is a pseudo p over permutations that all orders share.
    """
    where = _members(values, ())
    found = cross_products(rings(edges, where, max_order), where, (), permutations)
    p = pseudo_p(F.col("larger"), permutations)
    return found.select(
        F.col("layer").alias("order"), ratio(F.col("n") * F.col("cross"), F.col("s0") * F.col("z2")).alias("moran_i"),
        p.alias("p_sim"), (p < 0.05).alias("significant"),
    )


_SCOPE = ["scope", "place"]


def _scope_members(units: DataFrame, scopes: dict[str, str | None], variables: Sequence[str]) -> DataFrame:
    members = F.array(*[
        F.struct(F.lit(name).alias("scope"), (F.col(col).cast("string") if col else F.lit("all")).alias("place"))
        for name, col in scopes.items()
    ])
    y = F.array(*[F.col(v).cast("double") for v in variables])
    long = units.select("unit_id", y.alias("y"), F.explode(members).alias("_m")).select("unit_id", "_m.*", "y")
    return placed(long.where("place IS NOT NULL"), _SCOPE)


def _variable(variables: Sequence[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in variables]), (at + 1).cast("int"))


def autocorrelation_scopes(
    units: DataFrame, edges: DataFrame, scopes: dict[str, str | None], variables: Sequence[str], permutations: int = 999
) -> DataFrame:
    """Global Moran of every variable within every scope, with a pseudo p, in one job.

    ``scopes`` maps a scope name to the column whose groups it takes one by
    one, or None for all units together. Edges count inside a group only; units
    without a group, or with a null variable, take no part. A group without
    edges has no row.
    """
    where = _scope_members(units, scopes, variables)
    found = cross_products(single_layer(both_ways(edges), where, _SCOPE), where, _SCOPE, permutations)
    return found.select(
        *_SCOPE, _variable(variables, F.col("variable")).alias("variable"), "n",
        ratio(F.col("n") * F.col("cross"), F.col("s0") * F.col("z2")).alias("moran_i"),
        pseudo_p(F.col("larger"), permutations).alias("p_sim"),
    )


def local_scopes(
    units: DataFrame, edges: DataFrame, scopes: dict[str, str | None], variables: Sequence[str], permutations: int = 999
) -> DataFrame:
    """Local Moran and local G of every unit, variable and scope, in one job.

    Columns: I with its quadrant, pseudo p and significance; the z of G with
    its pseudo p and hot or cold spots. Both p-values come from the same
    conditional draws, which all variables of a scope share. Units without
    neighbours in a scope have no row there.
    """
    width = len(variables)
    where = _scope_members(units, scopes, variables)
    facts = spread(where, _SCOPE, width)
    drawn = local_counts(where, both_ways(edges), facts, _SCOPE, permutations, width)
    sums = where.groupBy(*_SCOPE).agg(F.array(*[
        F.struct(F.sum(F.col("y")[v]).alias("s"), F.sum(F.col("y")[v] * F.col("y")[v]).alias("q")) for v in range(width)
    ]).alias("_t"))
    wide = drawn.join(where.select(*_SCOPE, "unit_id", "y"), [*_SCOPE, "unit_id"]).join(facts, _SCOPE).join(sums, _SCOPE)
    one = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda v: F.struct(
        v.alias("at"), F.col("y")[v].alias("y"), F.col("near")[v].alias("near"), F.col("mean")[v].alias("mean"), F.col("z2")[v].alias("z2"),
        F.col("more")[v].alias("more"), F.col("high")[v].alias("high"), F.col("_t")[v].getField("s").alias("s"), F.col("_t")[v].getField("q").alias("q"),
    )))
    long = wide.select(*_SCOPE, "unit_id", "n", "degree", one.alias("_v")).select(*_SCOPE, "unit_id", "n", "degree", "_v.*")
    z, lag = F.col("y") - F.col("mean"), F.col("near") / F.col("degree") - F.col("mean")
    high, near_high = F.col("y") > F.col("mean"), F.col("near") > F.col("degree") * F.col("mean")
    quadrant = F.when(high & near_high, 1).when(~high & near_high, 2).when(~high & ~near_high, 3).otherwise(4)
    p_moran, p_g = pseudo_p(F.col("high"), permutations), pseudo_p(F.col("more"), permutations)
    _, g_z = _getis(F.col("y"), F.col("near"), F.col("degree"), F.col("n"), F.col("s"), F.col("q"))
    return long.select(
        *_SCOPE, _variable(variables, F.col("at")).alias("variable"), "unit_id", ratio((F.col("n") - 1) * z * lag, F.col("z2")).alias("local_i"),
        quadrant.alias("quadrant"), p_moran.alias("p_moran"), (p_moran < 0.05).alias("significant"),
        g_z.alias("g_z"), p_g.alias("p_g"), _spot(g_z, p_g).alias("spot"),
    )
