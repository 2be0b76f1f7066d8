"""Adjacency as an edge table ``(src, dst)`` with ``src < dst``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hemicycle.functions.frames import attach, group_window, rnd, shuffled, small_side
from hemicycle.functions.nearest import most_barred, nearest, quadtree
from hemicycle.functions.ordered import exact_quantiles, row_index
from hemicycle.operators.geometry import segments
from hemicycle.session import cut_lineage


def adjacency(vertices: DataFrame, contiguity: str = "queen", within: str | None = None) -> DataFrame:
    """Pairs of units that share a vertex (queen) or a segment (rook).

    ``within`` names a column both units must agree on (block diagonal).
    """
    if contiguity == "queen":
        keys = ["x", "y"]
        sides = vertices.select("unit_id", *keys, *([within] if within else [])).distinct()
    else:
        keys = ["ax", "ay", "bx", "by"]
        sides = segments(vertices)
        if within:
            sides = sides.join(vertices.select("unit_id", within).distinct(), "unit_id")
        sides = sides.select("unit_id", *keys, *([within] if within else [])).distinct()
    on = keys + ([within] if within else [])
    left, right = sides.withColumnRenamed("unit_id", "src"), sides.withColumnRenamed("unit_id", "dst")
    return left.join(shuffled(right), on).where("src < dst").select("src", "dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def edge_sides(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Districts of both ends of every edge in every plan.

    The plan table is read once: each row meets the edges of its unit and the
    two ends are brought together by one aggregation on (plan, edge). Edges
    with no assigned end have no row.
    """
    ends = edges.select(
        *edges.columns,
        F.explode(F.array(
            F.struct(F.col("src").alias("unit_id"), F.lit(True).alias("_first")),
            F.struct(F.col("dst").alias("unit_id"), F.lit(False).alias("_first")),
        )).alias("_end"),
    ).select(*edges.columns, "_end.*")
    placed = plans.where("district IS NOT NULL").join(small_side(ends), "unit_id")
    return placed.groupBy("plan_id", *edges.columns).agg(
        F.max(F.when(F.col("_first"), F.col("district"))).alias("src_district"),
        F.max(F.when(~F.col("_first"), F.col("district"))).alias("dst_district"),
    )


def cut_edges(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Edges between different districts per plan; an unassigned end differs."""
    sides = edge_sides(edges.select("src", "dst"), plans)
    cut = ~F.col("src_district").eqNullSafe(F.col("dst_district"))
    return sides.groupBy("plan_id").agg(F.count_if(cut).alias("cut_edges"))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest node id of each node's component, per key (e.g. plan).

    Alternating large-star and small-star steps shorten every path to one
    hop in a logarithmic number of rounds. Each round is checkpointed, and a
    count and a hash of the edges tell when nothing changed.
    """
    keys = list(keys)
    current = edges.where("src <> dst").select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    current = cut_lineage(current)
    seen = None
    while True:
        both = current.union(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        met = large.join(low, [*keys, "u"])
        small = met.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select(*keys, "u", F.col("m").alias("v"))
        )
        current = cut_lineage(small.distinct())
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = current.groupBy(*keys, F.col("u").alias("unit_id")).agg(F.min("v").alias("_root"))
    return nodes.select(*keys, "unit_id").join(roots, [*keys, "unit_id"], "left").select(
        *keys, "unit_id", F.coalesce("_root", "unit_id").alias("component")
    )


def contiguity(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Whether each district of each plan is one connected piece."""
    inside = edge_sides(edges.select("src", "dst"), plans).where("src_district = dst_district").select("plan_id", "src", "dst")
    parts = connected_components(plans, inside, ["plan_id"])
    placed = plans.join(shuffled(parts), ["plan_id", "unit_id"]).groupBy("plan_id", "district", "component").agg(F.count(F.lit(1)).alias("_n"))
    return placed.groupBy("plan_id", "district").agg(
        F.count(F.lit(1)).alias("components"), F.sum("_n").alias("n_units"), (F.count(F.lit(1)) == 1).alias("contiguous")
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of neighbours of every node, 0 included."""
    found = both_ways(edges).groupBy(F.col("src").alias("unit_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(found, "unit_id", "left").fillna(0, ["degree"])


def connect_islands(
    nodes: DataFrame, edges: DataFrame, max_km: float | None = None, to_islands: bool = True
) -> DataFrame:
    """New edges from nodes without neighbours to their nearest node.

    ``nodes`` is (unit_id, x, y) in metres. Islands act in id order and skip
    a node that already chose them; ``to_islands=False`` only allows nodes
    that had neighbours. The repeated search settles after a few rounds
    because only mutual first choices ever change.
    """
    nodes = cut_lineage(nodes.select("unit_id", "x", "y"))
    lonely = cut_lineage(degrees(nodes, edges).where("degree = 0").select("unit_id", "x", "y"))
    targets = nodes if to_islands else nodes.join(lonely, "unit_id", "left_anti")
    taken, before, index = None, None, None
    while True:
        room = 2 + most_barred(taken)
        if index is None or index.room < room:
            index = quadtree(targets, room=room)
        chosen = cut_lineage(nearest(lonely, targets, taken, index=index))
        state = chosen.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("unit_id", "near_id"))).first()
        if state == before or not to_islands:
            break
        before = state
        taken = chosen.join(lonely.select(F.col("unit_id").alias("near_id")), "near_id", "left_semi").where(
            "unit_id < near_id"
        ).select(F.col("near_id").alias("unit_id"), F.col("unit_id").alias("near_id"))
    out = chosen if max_km is None else chosen.where(F.col("distance") <= max_km * 1000)
    return out.select("unit_id", "near_id", rnd(F.col("distance") / 1000, 1).alias("km"))


def connect_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges joining every smaller component to the larger ones.

    Components are taken by size (then id). When one joins, the main part is
    the union of all earlier ones, so all closest pairs come from one search
    among nodes of earlier components: branch and bound, with one best distance
    a component, and no pairs inside a component.
    """
    parts = connected_components(nodes, edges)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ranked = cut_lineage(row_index(sizes, (), [F.col("size").desc(), "component"], "place"))
    placed = cut_lineage(nodes.join(parts, "unit_id").join(ranked, "component"))
    found = nearest(placed.where("place > 0"), placed, earlier="place", group="place")
    closest = F.min(F.struct("distance", "unit_id", "near_id"))
    return found.join(placed.select("unit_id", "component", "size"), "unit_id").groupBy("component", "size").agg(
        closest.alias("c")
    ).select(
        "component", "size", F.col("c.unit_id").alias("src"), F.col("c.near_id").alias("dst"),
        rnd(F.col("c.distance") / 1000, 1).alias("km"),
    )


def contract_graph(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups; ``groups`` is (unit_id, group)."""
    src = groups.select(F.col("unit_id").alias("src"), F.col("group").alias("a"))
    dst = groups.select(F.col("unit_id").alias("dst"), F.col("group").alias("b"))
    met = edges.join(src, "src").join(dst, "dst").where("a <> b")
    return met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    ids = nodes.where(keep).select("unit_id")
    return edges.join(ids.withColumnRenamed("unit_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("unit_id", "dst"), "dst", "left_semi"
    ).select("src", "dst")


#: sources that search at once, and hops between two checkpoints of a search
SOURCES, HOPS = 8, 4


def hop_counts(ways: DataFrame, sources: list) -> DataFrame:
    """``unit_id, hops, bits``: bit i says that source i reaches the unit in so many hops.

    All sources search at once. In an undirected graph a step leads to units one
    hop nearer, equally far or one hop farther, so two steps back are all that
    a search must remember; each unit has at most one row a source.
    """
    spark = ways.sparkSession
    kind = dict(ways.dtypes)["src"]
    start = spark.createDataFrame([(s, 1 << i) for i, s in enumerate(sources)], f"unit_id {kind}, bits long")
    last, front = start.withColumn("bits", F.lit(0).cast("long")), start
    found = [cut_lineage(start.select("unit_id", F.lit(0).alias("hops"), "bits"))]
    hops = 0
    while True:
        steps = []
        for _ in range(HOPS):
            hops += 1
            step = front.join(ways, F.col("unit_id") == F.col("src")).groupBy(F.col("dst").alias("unit_id")).agg(F.bit_or("bits").alias("bits"))
            old = last.unionByName(front).groupBy("unit_id").agg(F.bit_or("bits").alias("_old"))
            fresh = step.join(old, "unit_id", "left").select("unit_id", F.expr("bits & ~coalesce(_old, 0)").alias("bits")).where("bits <> 0")
            steps.append(fresh.withColumn("hops", F.lit(hops)))
            last, front = front, fresh
        block = steps[0]
        for s in steps[1:]:
            block = block.unionByName(s)
        block = cut_lineage(block.select("unit_id", "hops", "bits"))
        found.append(block)
        last, front = (block.where(F.col("hops") == h).select("unit_id", "bits") for h in (hops - 1, hops))
        if front.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def diameter(nodes: DataFrame, edges: DataFrame) -> int:
    """Longest shortest path of a connected graph, by bounds on eccentricities.

    A search from v bounds the eccentricity of every unit u at distance d by
    max(d, ecc(v) - d) and ecc(v) + d. Searches start where the bounds say
    most, and end when no unit's upper bound exceeds the largest lower one.
    """
    ways = cut_lineage(both_ways(edges).where("src <> dst").distinct())
    many = 1 << 30
    bounds = cut_lineage(nodes.select("unit_id", F.lit(0).alias("low"), F.lit(many).alias("high")).distinct())
    far = degrees(bounds.select("unit_id"), edges).orderBy(F.col("degree").desc(), "unit_id")
    sources = [r.unit_id for r in far.limit(1).collect()]
    while sources:
        bit = F.explode(F.expr(f"filter(sequence(0, {SOURCES - 1}), b -> shiftright(bits, b) & 1 = 1)")).alias("source")
        seen = cut_lineage(hop_counts(ways, sources).select("unit_id", "hops", bit))
        widest = F.broadcast(seen.groupBy("source").agg(F.max("hops").alias("ecc")))  # one row a source
        now = seen.join(widest, "source").groupBy("unit_id").agg(
            F.max(F.greatest("hops", F.col("ecc") - F.col("hops"))).alias("_low"), F.min(F.col("ecc") + F.col("hops")).alias("_high")
        )
        bounds = cut_lineage(bounds.join(now, "unit_id", "left").select(
            "unit_id", F.greatest("low", F.coalesce("_low", "low")).alias("low"), F.least("high", F.coalesce("_high", "high")).alias("high")
        ))
        best = bounds.agg(F.max("low")).first()[0]
        open_ = bounds.where(F.col("high") > best)
        ends = open_.orderBy(F.col("high").desc(), F.col("low").desc(), "unit_id").limit(SOURCES // 2).collect()
        middle = open_.orderBy("low", "high", "unit_id").limit(SOURCES // 2).collect()
        sources = sorted({r.unit_id for r in ends + middle})
    return best


def graph_stats(nodes: DataFrame, edges: DataFrame, with_diameter: bool = True) -> DataFrame:
    """Size, degrees, density, components and diameter.

    The diameter is null where the graph is not connected.
    """
    deg = degrees(nodes.select("unit_id"), edges)
    base = deg.agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"),
        F.avg("degree").alias("degree_mean"), F.max("degree").alias("degree_max"), F.min("degree").alias("degree_min"),
    )
    base = attach(base, exact_quantiles(deg, (), "degree", {"degree_median": 0.5}))
    parts = connected_components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    n = F.col("nodes")
    out = attach(base, parts).withColumns(
        {"density": F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0), "connected": F.col("components") == 1}
    )
    if not with_diameter:
        return out
    value = diameter(nodes, edges) if out.select("connected").first().connected else None
    return out.withColumn("diameter", F.lit(value).cast("int"))


def degree_by(nodes: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    return degrees(nodes, edges).groupBy(column).agg(
        F.avg("degree").alias("mean_degree"), F.count(F.lit(1)).alias("n")
    )


def top_degrees(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.col("degree").desc(), "unit_id").limit(n)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def national_nodes(nodes: DataFrame) -> DataFrame:
    """Node numbers region after region, for block-diagonal graphs."""
    inside = row_index(nodes.select("region", "unit_id"), ["region"], ["unit_id"], "_local")
    sizes = nodes.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    before = group_window(()).orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("region", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return inside.join(offsets, "region").select("region", "unit_id", (F.col("_offset") + F.col("_local")).alias("node"))


def edge_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the attributes of both ends."""
    out = edges.select("src", "dst")
    for end in ("src", "dst"):
        side = nodes.select([F.col(c).alias(end if c == "unit_id" else f"{end}_{c}") for c in nodes.columns])
        out = out.join(side, end)
    return out
