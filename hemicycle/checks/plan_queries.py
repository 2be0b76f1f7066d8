"""Checked queries: plan integrity, geometry, graphs, spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.checks import bridge as b
from hemicycle.checks.base import R, cte, query
from hemicycle.functions.frames import rnd, shuffled
from hemicycle.operators import geometry, graph, integrity, spatial
from hemicycle.plans import shape, table


cte("ways", "SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges")


def rounded(df, digits=6):
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select([rnd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pieces(spark, sf):
    return b.plans(spark, sf), b.unit_frame(spark, sf)


# ---- balance and splits ----

BAL = "bal AS (SELECT commune AS district, CAST(sum(population) AS BIGINT) AS population, min(region) AS label FROM unit_frame GROUP BY 1), id AS (SELECT avg(population) AS ideal FROM bal)"


@query("p1_population_balance", f"""WITH {BAL} SELECT district, population, label, {R('ideal', 6)} AS ideal, {R('population - ideal', 6)} AS deviation_abs,
 {R('(population - ideal) / ideal * 100', 6)} AS deviation_pct, abs((population - ideal) / ideal) <= 0.05e0 AS within_5pct,
 {R('max(abs((population - ideal) / ideal * 100)) OVER ()', 6)} AS max_deviation_pct FROM bal, id""")
def _(spark, sf):
    units = b.unit_frame(spark, sf).withColumn("district", F.col("commune"))
    return rounded(integrity.population_balance(units, "region"))


@query("p2_ideal_population", f"SELECT {R('sum(population) / 28e0', 6)} AS ideal FROM population")
def _(spark, sf):
    return rounded(integrity.ideal_population(b.population(spark, sf), 28))


def dev_sql(ideal: str) -> str:
    return f"""WITH i AS (SELECT *, {ideal} AS ideal FROM plan_population WINDOW w AS (PARTITION BY plan_id))
SELECT plan_id, {R('max(ideal)', 6)} AS ideal, count(*) AS n_districts, CAST(sum(population) AS BIGINT) AS total_population,
 {R('max(abs(population - ideal)) / max(ideal) * 100', 6)} AS max_dev_pct FROM i GROUP BY 1"""


@query("p3_max_deviation", dev_sql("avg(population) OVER w"))
def _(spark, sf):
    return rounded(integrity.max_deviation(b.plans(spark, sf), b.population(spark, sf)))


@query("p3_max_deviation_fixed_n", dev_sql("sum(population) OVER w / 7e0"))
def _(spark, sf):
    return rounded(integrity.max_deviation(b.plans(spark, sf), b.population(spark, sf), 7))


cte("cuts", """SELECT a.plan_id, e.src, e.dst, a.district AS d1, c.district AS d2 FROM edges e
JOIN plans a ON a.unit_id = e.src JOIN plans c ON c.unit_id = e.dst AND c.plan_id = a.plan_id""")


@query("p4_cut_edges", "SELECT plan_id, count(*) FILTER (d1 <> d2) AS cut_edges FROM cuts GROUP BY 1")
def _(spark, sf):
    return graph.cut_edges(b.edges(spark, sf), b.plans(spark, sf))


def band_plans(spark, sf):
    """Plans made of bands of grid rows, most of them connected."""
    cells = b.unit_cells(spark, sf).withColumn("plan_id", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return cells.select("plan_id", "unit_id", F.floor(F.col("cy") / (F.col("plan_id") * 4)).cast("int").alias("district"))


cte("band_plans", """SELECT CAST(p AS INT) AS plan_id, unit_id, CAST(cy // (p * 4) AS INT) AS district FROM unit_cells, range(1, 4) t(p)""")


BAND_COMPONENTS = """band_ways AS (SELECT p.plan_id, w.src, w.dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) w
 JOIN band_plans p ON p.unit_id = w.src JOIN band_plans q ON q.unit_id = w.dst AND q.plan_id = p.plan_id AND q.district = p.district),
reach(plan_id, unit_id, node) AS (SELECT plan_id, unit_id, unit_id FROM band_plans UNION
 SELECT r.plan_id, r.unit_id, w.dst FROM reach r JOIN band_ways w ON w.plan_id = r.plan_id AND w.src = r.node),
parts AS (SELECT plan_id, unit_id, min(node) AS component FROM reach GROUP BY ALL),
touching AS (SELECT plan_id, district, count(DISTINCT component) AS components, count(*) AS n_units, count(DISTINCT component) = 1 AS contiguous
 FROM band_plans JOIN parts USING (plan_id, unit_id) GROUP BY ALL)"""


@query("p5_contiguity", f"WITH RECURSIVE {BAND_COMPONENTS} SELECT * FROM touching")
def _(spark, sf):
    return graph.contiguity(b.edges(spark, sf), band_plans(spark, sf))


cte("frag", """SELECT plan_id, commune AS unit, district, CAST(sum(population) AS BIGINT) AS population, count(*) AS n
FROM plans JOIN unit_frame USING (unit_id) GROUP BY ALL""")
cte("unit_split", """SELECT plan_id, unit, count(*) AS nf, CAST(sum(population) AS BIGINT) AS pop, list_sort(list(district)) AS districts FROM frag GROUP BY ALL""")
cte("split_row", """SELECT plan_id, count(*) FILTER (nf > 1) AS split_units, sum((nf - 1) * pop) / CAST(sum(pop) AS DOUBLE) AS sev,
sum(pop) FILTER (nf > 1) / CAST(sum(pop) AS DOUBLE) AS aff, count(*) AS n_units FROM unit_split GROUP BY 1""")
cte("small_row", """SELECT plan_id, unit, district, population, population / CAST(pop AS DOUBLE) AS share
FROM frag JOIN unit_split USING (plan_id, unit) WHERE nf > 1 AND pop > 0 AND population / CAST(pop AS DOUBLE) < 0.1
UNION ALL SELECT plan_id, unit, district, population, 0e0 FROM frag JOIN unit_split USING (plan_id, unit) WHERE nf > 1 AND pop = 0""")


@query("p6_count_split_units", "SELECT plan_id, split_units FROM split_row")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    return integrity.split_measures(plans, units, ["commune"]).select("plan_id", "split_units")


@query("p7_split_severity", f"SELECT plan_id, {R('sev', 6)} AS split_severity FROM split_row")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    return rounded(integrity.split_measures(plans, units, ["commune"]).select("plan_id", "split_severity"))


@query("p7_split_severity_uniform", f"SELECT plan_id, {R('sum(nf - 1) / CAST(count(*) AS DOUBLE)', 6)} AS split_severity FROM unit_split GROUP BY 1")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    return rounded(integrity.split_severity_uniform(plans, units, "commune"))


cte("split_summary", f"""SELECT plan_id, CAST(unit AS VARCHAR) AS unit, nf AS n_fragments, districts, pop AS population,
 {R('pop / CAST(tot AS DOUBLE)', 4)} AS population_share, {R('(nf - 1) * (pop / CAST(tot AS DOUBLE))', 6)} AS split_severity, n_name AS name
FROM (SELECT *, sum(pop) OVER (PARTITION BY plan_id) AS tot FROM unit_split) JOIN nation ON unit = n_nationkey WHERE nf > 1""")


@query("p8_split_unit_summary", "SELECT * FROM split_summary")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    names = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("commune"), F.col("n_name").alias("nation_name"))
    return integrity.split_unit_summary(plans, units.join(names, "commune"), "commune", "nation_name")


@query("p9_small_fragments", f"SELECT plan_id, 'commune' AS level, CAST(unit AS VARCHAR) AS unit, district, population, {R('share', 6)} AS share FROM small_row")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    return rounded(integrity.small_fragments(integrity.fragments(plans, units, ["commune"])))


@query("p10_affected_population", f"SELECT plan_id, {R('aff', 4)} AS affected_share FROM split_row")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    return integrity.split_measures(plans, units, ["commune"]).select("plan_id", "affected_share")


@query("p11_plan_split_metrics", f"""WITH top AS (SELECT plan_id, list(unit ORDER BY population DESC, unit) AS most_split FROM
 (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY population DESC, unit) AS rn FROM split_summary) WHERE rn <= 5 GROUP BY 1),
sm AS (SELECT plan_id, count(*) AS small_fragments FROM small_row GROUP BY 1)
SELECT plan_id, split_units, {R('sev', 4)} AS split_severity, COALESCE(small_fragments, 0) AS small_fragments, {R('aff', 4)} AS affected_share,
 {R('split_units / CAST((SELECT count(DISTINCT commune) FROM units) AS DOUBLE)', 4)} AS split_share, COALESCE(most_split, []) AS most_split
FROM split_row LEFT JOIN sm USING (plan_id) LEFT JOIN top USING (plan_id)""")
def _(spark, sf):
    return integrity.plan_split_metrics(*pieces(spark, sf), "commune")


@query("p12_multi_level_split_metrics", f"""WITH l AS (SELECT plan_id, 'commune' AS level, CAST(commune AS VARCHAR) AS unit, district, population FROM plans JOIN unit_frame USING (unit_id)
 UNION ALL SELECT plan_id, 'region', CAST(region AS VARCHAR), district, population FROM plans JOIN unit_frame USING (unit_id)),
u AS (SELECT plan_id, level, unit, count(DISTINCT district) AS nf, sum(population) AS pop FROM l GROUP BY ALL),
r AS (SELECT plan_id, level, count(*) FILTER (nf > 1) AS split_units, count(*) AS n_units, {R('sum(pop) FILTER (nf > 1) / CAST(sum(pop) AS DOUBLE)', 4)} AS aff,
 CAST(sum(pop) AS DOUBLE) AS total_population FROM u GROUP BY ALL)
SELECT plan_id, level, split_units, n_units, {R('split_units / CAST(n_units AS DOUBLE)', 4)} AS split_share, {R('aff * total_population', 4)} AS affected_population,
 total_population, {R('aff * 100', 4)} AS affected_pct FROM r""")
def _(spark, sf):
    return integrity.multi_level_split_metrics(*pieces(spark, sf), ["commune", "region"])


@query("p15_penalised_score", f"""SELECT plan_id, {R('plan_id * 1e0', 6)} AS base_score, {R('plan_id - 0.25e0 * sev', 6)} AS score FROM split_row""")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    severity = integrity.split_measures(plans, units, ["commune", "region"]).select("plan_id", "level", "split_severity")
    base = plans.select("plan_id").distinct().withColumn("base_score", F.col("plan_id").cast("double"))
    return rounded(integrity.penalised_score(base, severity, {"commune": 0.25}))


def event_stats(spark, sf):
    """Plan statistics taken from events: one event is one plan."""
    e = b.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("plan_id"), F.col("event_type").alias("scenario"), F.col("value").alias("max_dev_pct"),
        (F.col("user_id") + 1).alias("cut_edges"),
        F.when(F.col("event_id") % 11 != 0, F.pmod(F.col("event_id") * 37, F.lit(101)) / 101).alias("pp_mean"),
        (F.pmod(F.col("event_id") * 13, F.lit(29)) / 10).alias("split_severity"),
    )


cte("event_stats", """SELECT event_id AS plan_id, event_type AS scenario, value AS max_dev_pct, user_id + 1 AS cut_edges,
CASE WHEN event_id % 11 <> 0 THEN (event_id * 37) % 101 / 101e0 END AS pp_mean, (event_id * 13) % 29 / 10e0 AS split_severity FROM events""")
SCORE = """sc AS (SELECT *, -max_dev_pct / (max(max_dev_pct) OVER () + 1e-10) + (pp - min(pp) OVER ()) / (max(pp) OVER () - min(pp) OVER () + 1e-10)
 - cut_edges / (max(cut_edges) OVER () + 1e-10) - 0.5e0 * split_severity / (max(split_severity) OVER () + 1e-10) AS score
FROM (SELECT *, COALESCE(pp_mean, (SELECT quantile_cont(pp_mean, 0.5) FROM event_stats)) AS pp FROM event_stats))"""


@query("p16_ensemble_score", f"WITH {SCORE} SELECT plan_id, {R('score', 6)} AS score FROM sc")
def _(spark, sf):
    return rounded(integrity.ensemble_score(event_stats(spark, sf), 0.5)).select("plan_id", "score")


@query("p16_reference_plans", f"WITH {SCORE}, rs AS (SELECT plan_id, {R('score', 9)} AS score FROM sc) SELECT arg_max(plan_id, (score, -plan_id)) AS reference_plan, arg_min(plan_id, (score, plan_id)) AS extreme_plan FROM rs")
def _(spark, sf):
    scored = rounded(integrity.ensemble_score(event_stats(spark, sf), 0.5), 9)
    return integrity.reference_plans(scored)


@query("p17_reference_plan_detail", f"""SELECT plan_id, district, CAST(sum(population) AS BIGINT) AS population, count(*) AS n_units, count(DISTINCT commune) AS n_communes,
 {R('(sum(population) - (SELECT sum(population) / 8e0 FROM unit_frame)) / (SELECT sum(population) / 8e0 FROM unit_frame) * 100', 2)} AS deviation_pct
FROM plans JOIN unit_frame USING (unit_id) WHERE plan_id = 3 GROUP BY 1, 2""")
def _(spark, sf):
    plans, units = pieces(spark, sf)
    return integrity.reference_plan_detail(plans.where("plan_id = 3"), units, 8)


@query("p18_preserve_violations", f"""WITH RECURSIVE {BAND_COMPONENTS},
sp AS (SELECT plan_id, count(*) FILTER (nd > 1) AS split FROM (SELECT plan_id, commune, count(DISTINCT district) AS nd FROM band_plans JOIN units USING (unit_id) GROUP BY ALL) GROUP BY 1),
pd AS (SELECT plan_id, district, sum(population) AS p FROM band_plans JOIN population USING (unit_id) GROUP BY ALL),
dv AS (SELECT plan_id, max(abs(p - ideal)) / max(ideal) * 100 AS dev FROM (SELECT *, avg(p) OVER (PARTITION BY plan_id) AS ideal FROM pd) GROUP BY 1)
SELECT plan_id, split = 0 AS units_whole, (SELECT bool_and(contiguous) FROM touching t WHERE t.plan_id = sp.plan_id) AS contiguous, dev <= 10 AS population_ok
FROM sp JOIN dv USING (plan_id)""")
def _(spark, sf):
    plans, units = band_plans(spark, sf), b.unit_frame(spark, sf)
    return integrity.preserve_violations(plans, units, ["commune"], 0.10, graph.contiguity(b.edges(spark, sf), plans))


def feasible_sql(unit: str) -> str:
    return f"""WITH u AS (SELECT {unit} AS unit, sum(population) AS p FROM unit_frame GROUP BY 1),
t AS (SELECT CAST(sum(p) AS BIGINT) AS total_population, sum(p) / 8e0 AS ideal, arg_max(unit, (p, -unit)) AS largest_unit, CAST(max(p) AS BIGINT) AS largest_population FROM u)
SELECT total_population, {R('ideal', 6)} AS ideal, largest_unit, largest_population, {R('GREATEST(0, largest_population / ideal - 1)', 6)} AS required_tolerance,
 GREATEST(0, largest_population / ideal - 1) <= 0.1e0 AS feasible, 0.1e0 AS requested_tolerance,
 CASE WHEN largest_population / ideal - 1 > 0.1e0 THEN 'indivisible_unit_exceeds_population_bound' END AS reason FROM t"""


@query("p19_population_feasibility", feasible_sql("unit_id"))
def _(spark, sf):
    return rounded(integrity.population_feasibility(b.unit_frame(spark, sf), 8, 0.1))


@query("p19_population_feasibility_hard", feasible_sql("region"))
def _(spark, sf):
    return rounded(integrity.population_feasibility(b.unit_frame(spark, sf), 8, 0.1, "region"))


@query("p20_effective_district_count", """SELECT commune, count(*) AS n_units,
 CAST(CASE WHEN count(*) < 80 THEN LEAST(16, GREATEST(2, count(*) // 4)) ELSE 16 END AS INT) AS districts FROM units GROUP BY 1""")
def _(spark, sf):
    sizes = b.units(spark, sf).groupBy("commune").agg(F.count(F.lit(1)).alias("n_units"))
    return sizes.withColumn("districts", integrity.effective_district_count(F.col("n_units"), 16))


# ---- plan table ----

@query("c11_propagate_assignment", "SELECT CAST(p AS INT) AS plan_id, unit_id, CAST((commune + p) % 4 AS INT) AS district FROM units, range(0, 3) t(p) WHERE commune < 20")
def _(spark, sf):
    coarse = b.table(spark, sf, "nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("unit_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("plan_id"))
    plan = coarse.withColumn("district", ((F.col("unit_id") + F.col("plan_id")) % 4).cast("int"))
    return table.propagate_assignment(plan, b.units(spark, sf), "commune")


@query("c12_sample_plans", """SELECT * FROM plans WHERE plan_id IN
 (SELECT plan_id FROM (SELECT DISTINCT plan_id FROM plans) ORDER BY substr(md5('7:' || plan_id), 1, 15), plan_id LIMIT 3)""")
def _(spark, sf):
    return table.sample_plans(b.plans(spark, sf), 3, seed=7)


@query("c13_evenly_spaced_plans", "SELECT * FROM plans WHERE plan_id IN (0, 2, 4, 7)")
def _(spark, sf):
    return table.evenly_spaced_plans(b.plans(spark, sf), 4)


@query("c16_plan_from_column", "SELECT 0 AS plan_id, unit_id, region AS district FROM units")
def _(spark, sf):
    return table.plan_from_column(b.units(spark, sf), "region")


@query("c16_modulo_plan", "SELECT 0 AS plan_id, unit_id, (row_number() OVER (ORDER BY commune, unit_id) - 1) % 5 AS district FROM units")
def _(spark, sf):
    return table.modulo_plan(b.units(spark, sf), 5, ["commune", "unit_id"])


@query("b14_filter_plans", "SELECT plan_id, scenario AS unit_id, cut_edges AS district FROM event_stats WHERE max_dev_pct <= 20 AND COALESCE(pp_mean, 0) >= 0.2e0 AND cut_edges <= 120")
def _(spark, sf):
    stats = event_stats(spark, sf)
    rows = stats.select("plan_id", F.col("scenario").alias("unit_id"), F.col("cut_edges").alias("district"))
    return table.filter_plans(rows, stats, max_dev=20, min_pp=0.2, max_cut=120)


@query("b15_validity_filter", """WITH l(t, i) AS (VALUES (0.00001e0, 1), (0.000015e0, 2), (0.00002e0, 3), (1e0, 4)),
h AS (SELECT t FROM l WHERE EXISTS (SELECT 1 FROM event_stats WHERE max_dev_pct <= t * 100) ORDER BY i LIMIT 1)
SELECT plan_id, max_dev_pct, (SELECT t FROM h) AS tolerance_used, COALESCE((SELECT t FROM h) <> 0.00001e0, true) AS fallback
FROM event_stats WHERE max_dev_pct <= COALESCE((SELECT t FROM h) * 100, 1e300)""")
def _(spark, sf):
    stats = event_stats(spark, sf).select("plan_id", "max_dev_pct")
    return table.validity_filter(stats, 0.00001)


# ---- geometry ----

cte("measures", """SELECT unit_id, CASE WHEN unit_id % 10 = 3 THEN 750000e0 ELSE 1000000e0 END AS area,
CASE WHEN unit_id % 10 = 3 THEN 6000e0 ELSE 4000e0 END AS perimeter FROM unit_cells""")
cte("inner_border", "SELECT plan_id, d1 AS district, count(*) * 1000e0 AS inner_len FROM cuts WHERE d1 = d2 GROUP BY ALL")
cte("dissolved", """SELECT plan_id, district, sum(area) AS area, count(*) AS n_units, sum(perimeter) - 2 * COALESCE(max(inner_len), 0) AS perimeter
FROM plans JOIN measures USING (unit_id) LEFT JOIN inner_border USING (plan_id, district) GROUP BY ALL""")


@query("g1_area_perimeter", f"SELECT unit_id, {R('area', 6)} AS area, {R('perimeter', 6)} AS perimeter FROM measures")
def _(spark, sf):
    return rounded(geometry.area_perimeter(b.vertices(spark, sf)))


@query("g2_polsby_popper", f"SELECT unit_id, {R('4 * pi() * area / (perimeter * perimeter)', 6)} AS polsby_popper FROM shape_measures")
def _(spark, sf):
    m = geometry.area_perimeter(b.shapes(spark, sf))
    return rounded(m.select("unit_id", geometry.polsby_popper(F.col("area"), F.col("perimeter")).alias("polsby_popper")))


@query("g3_schwartzberg", f"SELECT unit_id, {R('2 * pi() * sqrt(area / pi()) / perimeter', 6)} AS schwartzberg FROM shape_measures")
def _(spark, sf):
    m = geometry.area_perimeter(b.shapes(spark, sf))
    return rounded(m.select("unit_id", geometry.schwartzberg(F.col("area"), F.col("perimeter")).alias("schwartzberg")))


@query("g4_convex_hull_ratio", f"SELECT unit_id, {R('area / hull', 6)} AS convex_hull_ratio FROM shape_measures")
def _(spark, sf):
    v = b.shapes(spark, sf)
    both = geometry.area_perimeter(v).join(shuffled(geometry.hull_area(geometry.hulls(v))), "unit_id")
    return rounded(both.select("unit_id", (F.col("area") / F.col("hull_area")).alias("convex_hull_ratio")))


@query("g5_reock", f"SELECT unit_id, {R('area / (pi() * r * r)', 6)} AS reock FROM shape_measures")
def _(spark, sf):
    v = b.shapes(spark, sf)
    both = geometry.area_perimeter(v).join(shuffled(geometry.enclosing_circles(v, ["unit_id"])), "unit_id")
    return rounded(both.select("unit_id", (F.col("area") / (F.pi() * F.col("r") * F.col("r"))).alias("reock")))


@query("g6_dissolve", f"SELECT plan_id, district, {R('area', 3)} AS area, n_units, {R('perimeter', 3)} AS perimeter FROM dissolved")
def _(spark, sf):
    v = b.vertices(spark, sf)
    return rounded(shape.dissolve(b.plans(spark, sf), geometry.area_perimeter(v), geometry.shared_borders(v)), 3)


COMPACT = {"polsby_popper": "4 * pi() * area / (perimeter * perimeter)", "schwartzberg": "2 * pi() * sqrt(area / pi()) / perimeter",
           "convex_hull_ratio": "area / hull", "reock": "area / (pi() * r * r)"}


@query("g7_compactness", f"SELECT unit_id, {', '.join(f'{R(t, 6)} AS {c}' for c, t in COMPACT.items())}, {R('(' + ' + '.join(COMPACT.values()) + ') / 4', 6)} AS mean_compactness FROM shape_measures")
def _(spark, sf):
    return rounded(geometry.compactness(b.shapes(spark, sf)))


PP, SW = COMPACT["polsby_popper"], COMPACT["schwartzberg"]


@query("g8_spatial_summary", f"""SELECT unit_id, population, {R('area / 1e6', 3)} AS area_km2, {R('perimeter / 1e3', 3)} AS perimeter_km, {R(PP, 3)} AS polsby_popper,
 {R(SW, 3)} AS schwartzberg, {R('population / (area / 1e6)', 3)} AS density FROM measures JOIN unit_frame USING (unit_id)""")
def _(spark, sf):
    return geometry.spatial_summary(b.vertices(spark, sf), b.unit_frame(spark, sf))


@query("g8_spatial_summary_by_region", f"""SELECT region, {R('sum(area / 1e6)', 3)} AS area_km2, CAST(sum(population) AS BIGINT) AS population, {R(f'avg({PP})', 3)} AS polsby_popper,
 {R(f'avg({SW})', 3)} AS schwartzberg, {R('avg(population / (area / 1e6))', 3)} AS density FROM measures JOIN unit_frame USING (unit_id) GROUP BY 1""")
def _(spark, sf):
    return geometry.spatial_summary(b.vertices(spark, sf), b.unit_frame(spark, sf), "region")


@query("g9_reock_by_plan")
def _(spark, sf):
    return rounded(geometry.reock_by_plan(b.plans(spark, sf), b.vertices(spark, sf)))


@query("g10_centroid", f"SELECT unit_id, {R('(cx + 0.5e0) * 1000', 3)} AS x, {R('(cy + 0.5e0) * 1000', 3)} AS y FROM unit_cells")
def _(spark, sf):
    return rounded(geometry.centroid(b.vertices(spark, sf)), 3)


@query("b19_project_utm")
def _(spark, sf):
    points = b.unit_cells(spark, sf).select("unit_id", (F.col("cx") / 100 - 71).alias("lon"), (F.col("cy") / 100 - 33.5).alias("lat"))
    return rounded(geometry.project_utm(points), 3)


@query("p13_plan_summary", f"""WITH p AS (SELECT *, avg(population) OVER (PARTITION BY plan_id) AS ideal FROM plan_population),
ce AS (SELECT plan_id, unnest([d1, d2]) AS district FROM cuts WHERE d1 <> d2), cn AS (SELECT plan_id, district, count(*) AS cut_edges FROM ce GROUP BY ALL)
SELECT plan_id, district, n_units, population, {R('area / 1e6', 6)} AS area_km2, {R(PP, 6)} AS polsby_popper, {R('(population - ideal) / ideal * 100', 6)} AS deviation_pct,
 abs((population - ideal) / ideal) <= 0.05e0 AS within_5pct, COALESCE(cut_edges, 0) AS cut_edges
FROM dissolved JOIN p USING (plan_id, district) LEFT JOIN cn USING (plan_id, district)""")
def _(spark, sf):
    v = b.vertices(spark, sf)
    return rounded(shape.plan_summary(b.plans(spark, sf), b.unit_frame(spark, sf), geometry.area_perimeter(v), geometry.shared_borders(v), b.edges(spark, sf)))


@query("p14_position_plans", f"""WITH d AS (SELECT plan_id, count(*) AS n_districts, CAST(sum(population) AS BIGINT) AS total_population,
 {R('max(abs(population - ideal)) / max(ideal) * 100', 4)} AS max_dev_pct FROM (SELECT *, avg(population) OVER (PARTITION BY plan_id) AS ideal FROM plan_population) GROUP BY 1),
p AS (SELECT plan_id, {R(f'avg({PP})', 4)} AS pp_mean FROM dissolved GROUP BY 1), c AS (SELECT plan_id, count(*) FILTER (d1 <> d2) AS cut_edges FROM cuts GROUP BY 1)
SELECT d.*, pp_mean, cut_edges, split_units, {R('sev', 4)} AS split_severity, {R('aff', 4)} AS affected_share
FROM d JOIN p USING (plan_id) JOIN c USING (plan_id) JOIN split_row USING (plan_id)""")
def _(spark, sf):
    v = b.vertices(spark, sf)
    return shape.position_plans(b.plans(spark, sf), b.unit_frame(spark, sf), geometry.area_perimeter(v), geometry.shared_borders(v), b.edges(spark, sf), "commune")


# ---- graph ----

QUEEN = "SELECT DISTINCT a.unit_id AS src, c.unit_id AS dst FROM vertices a JOIN vertices c ON a.x = c.x AND a.y = c.y AND a.unit_id < c.unit_id"


@query("h1_adjacency_queen", QUEEN)
def _(spark, sf):
    return graph.adjacency(b.vertices(spark, sf), "queen")


@query("h1_adjacency_rook", "SELECT src, dst FROM edges")
def _(spark, sf):
    return b.edges(spark, sf)


def centres(spark, sf):
    return geometry.centroid(b.vertices(spark, sf))


cte("centres", "SELECT unit_id, (cx + 0.5e0) * 1000 AS x, (cy + 0.5e0) * 1000 AS y FROM unit_cells")
cte("alone", "SELECT * FROM centres WHERE unit_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")


# islands act in id order and skip one that chose them: a first choice is kept unless it is a mutual one of a smaller id
@query("h2_connect_islands", f"""WITH RECURSIVE d AS MATERIALIZED (SELECT a.unit_id, c.unit_id AS near_id, sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) AS dist
 FROM alone a, centres c WHERE c.unit_id <> a.unit_id),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY dist, near_id) AS rn FROM d),
q AS MATERIALIZED (SELECT * FROM o WHERE rn <= 40),
turn AS MATERIALIZED (SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS t FROM alone),
go(t, taken) AS (SELECT 0, CAST([] AS STRUCT(u BIGINT, v BIGINT)[]) UNION ALL
 SELECT go.t + 1, list_append(taken, (SELECT struct_pack(u := q.unit_id, v := q.near_id) FROM q JOIN turn USING (unit_id)
  WHERE turn.t = go.t + 1 AND NOT list_contains(go.taken, struct_pack(u := q.near_id, v := q.unit_id)) ORDER BY q.rn LIMIT 1)) FROM go WHERE go.t < (SELECT count(*) FROM alone)),
p AS (SELECT unnest(taken) AS p FROM go WHERE t = (SELECT count(*) FROM alone))
SELECT p.u AS unit_id, p.v AS near_id, {R('dist / 1000', 1)} AS km FROM p JOIN d ON d.unit_id = p.u AND d.near_id = p.v""")
def _(spark, sf):
    return graph.connect_islands(centres(spark, sf), b.edges(spark, sf))


@query("h2_connect_islands_mainland", f"""WITH d AS (SELECT a.unit_id, c.unit_id AS near_id, sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) AS dist
 FROM alone a, centres c WHERE c.unit_id NOT IN (SELECT unit_id FROM alone)),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY dist, near_id) AS rn FROM d)
SELECT unit_id, near_id, {R('dist / 1000', 1)} AS km FROM r WHERE rn = 1 AND dist <= 90000""")
def _(spark, sf):
    return graph.connect_islands(centres(spark, sf), b.edges(spark, sf), max_km=90.0, to_islands=False)


# the grid is one component and every other customer stands alone
@query("h3_connect_components", f"""WITH RECURSIVE hop(a, b) AS (SELECT unit_id, unit_id FROM centres UNION SELECT hop.a, w.dst FROM hop JOIN ways w ON w.src = hop.b),
cp AS MATERIALIZED (SELECT a AS unit_id, min(b) AS component, count(*) AS size FROM hop GROUP BY a),
rk AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS place FROM (SELECT DISTINCT component, size FROM cp)),
pt AS MATERIALIZED (SELECT unit_id, component, cp.size, place, x, y FROM centres JOIN cp USING (unit_id) JOIN rk USING (component)),
d AS (SELECT p.component, p.size, p.unit_id AS src, q.unit_id AS dst, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS dist FROM pt p JOIN pt q ON q.place < p.place),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY dist, src, dst) AS rn FROM d)
SELECT component, size, src, dst, {R('dist / 1000', 1)} AS km FROM r WHERE rn = 1""")
def _(spark, sf):
    return graph.connect_components(centres(spark, sf), b.edges(spark, sf))


@query("h4_contract_graph", """SELECT DISTINCT LEAST(a.commune, c.commune) AS src, GREATEST(a.commune, c.commune) AS dst
FROM edges JOIN units a ON a.unit_id = src JOIN units c ON c.unit_id = dst WHERE a.commune <> c.commune""")
def _(spark, sf):
    groups = b.units(spark, sf).select("unit_id", F.col("commune").alias("group"))
    return graph.contract_graph(b.edges(spark, sf), groups)


cte("near", "SELECT src, dst FROM edges WHERE src // 8 = dst // 8 UNION ALL SELECT dst, src FROM edges WHERE src // 8 = dst // 8")


@query("h5_connected_components", """WITH RECURSIVE r(unit_id, node) AS (SELECT unit_id, unit_id FROM same_row UNION
 SELECT r.unit_id, n.dst FROM r JOIN near n ON n.src = r.node)
SELECT unit_id, min(node) AS component FROM r GROUP BY 1""".replace("same_row", "units"))
def _(spark, sf):
    return graph.connected_components(b.units(spark, sf), row_edges(spark, sf))


def row_edges(spark, sf):
    """Neighbours within blocks of eight, so that there are many components."""
    return b.edges(spark, sf).where("floor(src / 8) = floor(dst / 8)")


DEG = "deg AS (SELECT unit_id, region, commune, (SELECT count(*) FROM edges WHERE src = unit_id OR dst = unit_id) AS degree FROM units)"


@query("h6_graph_stats", f"""WITH {DEG} SELECT count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, {R('avg(degree)', 6)} AS degree_mean, max(degree) AS degree_max,
 min(degree) AS degree_min, {R('quantile_cont(degree, 0.5)', 6)} AS degree_median, 1 + (SELECT count(*) FROM alone) AS components,
 {R('sum(degree) / CAST(count(*) * (count(*) - 1) AS DOUBLE)', 9)} AS density, (SELECT count(*) FROM alone) = 0 AS connected FROM deg""")
def _(spark, sf):
    return rounded(graph.graph_stats(b.units(spark, sf), b.edges(spark, sf), with_diameter=False), 9).withColumn("degree_mean", rnd("degree_mean", 6))


@query("h6_graph_stats_diameter", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a.commune AS src, c.commune AS dst FROM ways JOIN units a ON a.unit_id = src JOIN units c ON c.unit_id = dst WHERE a.commune <> c.commune),
nd AS (SELECT DISTINCT commune AS unit_id FROM units), dg AS (SELECT unit_id, count(src) AS degree FROM nd LEFT JOIN e ON src = unit_id GROUP BY 1),
hop(a, b, d) AS (SELECT unit_id, unit_id, 0 FROM nd UNION SELECT hop.a, e.dst, d + 1 FROM hop JOIN e ON e.src = hop.b WHERE d < 26),
sp AS (SELECT a, b, min(d) AS d FROM hop GROUP BY a, b), cn AS (SELECT a, min(b) AS c FROM sp GROUP BY a)
SELECT count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, {R('avg(degree)', 9)} AS degree_mean, max(degree) AS degree_max, min(degree) AS degree_min,
 {R('quantile_cont(degree, 0.5)', 9)} AS degree_median, (SELECT count(DISTINCT c) FROM cn) AS components, {R('sum(degree) / CAST(count(*) * (count(*) - 1) AS DOUBLE)', 9)} AS density,
 (SELECT count(DISTINCT c) FROM cn) = 1 AS connected, CASE WHEN (SELECT count(DISTINCT c) FROM cn) = 1 THEN (SELECT max(d) FROM sp) END AS diameter FROM dg""")
def _(spark, sf):
    groups = b.units(spark, sf).select("unit_id", F.col("commune").alias("group"))
    nodes = groups.select(F.col("group").alias("unit_id")).distinct()
    return rounded(graph.graph_stats(nodes, graph.contract_graph(b.edges(spark, sf), groups)), 9)


@query("h7_subgraph", "SELECT src, dst FROM edges WHERE src IN (SELECT unit_id FROM units WHERE region = 2) AND dst IN (SELECT unit_id FROM units WHERE region = 2)")
def _(spark, sf):
    return graph.subgraph(b.units(spark, sf), b.edges(spark, sf), F.col("region") == 2)


@query("h8_degree_by_region", f"WITH {DEG} SELECT region, {R('avg(degree)', 6)} AS mean_degree, count(*) AS n FROM deg GROUP BY 1")
def _(spark, sf):
    return rounded(graph.degree_by(b.units(spark, sf), b.edges(spark, sf), "region"))


@query("h8_top_degrees", f"WITH {DEG} SELECT unit_id, region, degree FROM deg ORDER BY degree DESC, unit_id LIMIT 20")
def _(spark, sf):
    return graph.top_degrees(b.units(spark, sf), b.edges(spark, sf), 20).select("unit_id", "region", "degree")


@query("h8_degree_histogram", f"WITH {DEG} SELECT degree, count(*) AS n FROM deg GROUP BY 1")
def _(spark, sf):
    return graph.degree_histogram(b.units(spark, sf), b.edges(spark, sf))


@query("h9_national_graph_blocks", "SELECT src, dst FROM edges JOIN units a ON a.unit_id = src JOIN units c ON c.unit_id = dst WHERE a.region = c.region")
def _(spark, sf):
    return graph.adjacency(b.vertices(spark, sf), "rook", within="region")


@query("h9_national_nodes", "SELECT region, unit_id, row_number() OVER (ORDER BY region, unit_id) - 1 AS node FROM units")
def _(spark, sf):
    return graph.national_nodes(b.units(spark, sf))


@query("a17_edge_list", """SELECT src, dst, a.commune AS src_commune, a.region AS src_region, c.commune AS dst_commune, c.region AS dst_region
FROM edges JOIN units a ON a.unit_id = src JOIN units c ON c.unit_id = dst""")
def _(spark, sf):
    return graph.edge_list(b.units(spark, sf), b.edges(spark, sf))


# ---- spatial autocorrelation ----

def values(spark, sf):
    return b.population(spark, sf).select("unit_id", F.col("population").cast("double").alias("value"))


cte("zv", "SELECT unit_id, CAST(population AS DOUBLE) AS value, population - avg(population) OVER () AS z, count(*) OVER () AS n FROM population")
cte("lagged", "SELECT src AS unit_id, avg(z) AS lag FROM ways JOIN zv ON unit_id = dst GROUP BY 1")


@query("s1_spatial_lag", f"SELECT src AS unit_id, {R('avg(value)', 6)} AS lag FROM ways JOIN zv ON unit_id = dst GROUP BY 1")
def _(spark, sf):
    return rounded(spatial.spatial_lag(values(spark, sf), b.edges(spark, sf)))


MORAN = """i AS (SELECT max(n) / CAST(count(lag) AS DOUBLE) * sum(z * lag) / sum(z * z) AS mi, max(n) AS n, count(lag) AS s0 FROM zv LEFT JOIN lagged USING (unit_id)),
dg AS (SELECT src, count(*) AS d FROM ways GROUP BY 1),
ww AS (SELECT w.src, w.dst, 1e0 / a.d AS w1, 1e0 / c.d AS w2 FROM ways w JOIN dg a ON a.src = w.src JOIN dg c ON c.src = w.dst),
s AS (SELECT sum(pow(w1 + w2, 2)) / 2 AS s1 FROM ww), q AS (SELECT sum(pow(t, 2)) AS s2 FROM (SELECT src, sum(w1) + sum(w2) AS t FROM ww GROUP BY 1))"""


@query("s2_moran_global", f"""WITH {MORAN} SELECT n, {R('mi', 6)} AS moran_i, {R('''(mi + 1e0 / (n - 1)) / sqrt((CAST(n AS DOUBLE) * n * s1 - n * s2 + 3e0 * s0 * s0) / ((CAST(n AS DOUBLE) * n - 1) * s0 * s0)
 - pow(1e0 / (n - 1), 2))''', 6)} AS z_norm FROM i, s, q""")
def _(spark, sf):
    return rounded(spatial.moran_global(values(spark, sf), b.edges(spark, sf)))


_PERMUTED = """pos AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS pos, z FROM zv),
pm AS (SELECT k, unit_id, row_number() OVER (PARTITION BY k ORDER BY md5(k || ':' || unit_id), unit_id) - 1 AS r FROM zv, range(1, {draws} + 1) t(k)),
pz AS MATERIALIZED (SELECT k, pm.unit_id, z FROM pm JOIN pos ON r = pos UNION ALL SELECT 0, unit_id, z FROM zv)"""


@query("s2_moran_permutations", f"""WITH {MORAN}, {_PERMUTED.format(draws=999)},
cr AS (SELECT a.k, sum(a.z * c.z * w1) AS c FROM ww JOIN pz a ON a.unit_id = src JOIN pz c ON c.unit_id = dst AND c.k = a.k GROUP BY 1),
o AS (SELECT c AS obs, (SELECT sum(z * z) FROM zv) AS z2 FROM cr WHERE k = 0),
lg AS (SELECT count(*) AS larger FROM cr, o WHERE k > 0 AND c >= obs - 1e-9 * z2)
SELECT n, {R('mi', 6)} AS moran_i, {R('''(mi + 1e0 / (n - 1)) / sqrt((CAST(n AS DOUBLE) * n * s1 - n * s2 + 3e0 * s0 * s0) / ((CAST(n AS DOUBLE) * n - 1) * s0 * s0)
 - pow(1e0 / (n - 1), 2))''', 6)} AS z_norm, {R('(least(larger, 999 - larger) + 1) / 1e3', 6)} AS p_sim FROM i, s, q, lg""")
def _(spark, sf):
    return rounded(spatial.moran_global(values(spark, sf), b.edges(spark, sf), permutations=999))


LOCAL = f"""{R('(n - 1) / sum(z * z) OVER () * z * COALESCE(lag, 0)', 6)} AS local_i,
 CASE WHEN z > 0 AND COALESCE(lag, 0) > 0 THEN 1 WHEN z <= 0 AND COALESCE(lag, 0) > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant"""


@query("s3_moran_local", f"""SELECT unit_id, value, {LOCAL} FROM zv LEFT JOIN lagged USING (unit_id)""")
def _(spark, sf):
    return rounded(spatial.moran_local(values(spark, sf), b.edges(spark, sf)))


def _drawn(keys: str, name: str) -> str:
    """CTEs: placed ``m (keys, unit_id, y)``, its neighbours, and 999 conditional draws counted by unit and variable."""
    on, a, by = (f"USING ({keys})", f"{keys}, ", f"PARTITION BY {keys}") if keys else ("ON true", "", "")
    both = " AND ".join([f"x.{k} = c.{k}" for k in keys.split(", ") if k] or ["true"])
    return f"""pl AS MATERIALIZED (SELECT *, row_number() OVER ({by} ORDER BY unit_id) - 1 AS pos, count(*) OVER ({by}) AS n FROM m),
nb AS MATERIALIZED (SELECT {"".join(f"x.{k}, " for k in keys.split(", ") if k)}x.unit_id, count(*) AS d, [sum(c.y[1]), sum(c.y[len(c.y)])] AS near
 FROM (SELECT DISTINCT src, dst FROM ways) JOIN pl x ON x.unit_id = src JOIN pl c ON c.unit_id = dst AND {both} GROUP BY ALL),
un AS MATERIALIZED (SELECT {a}unit_id, pos, n, y, d, near FROM pl JOIN nb USING ({a}unit_id)),
sl AS (SELECT {a}max(n) AS n, max(d) AS d FROM un GROUP BY ALL),
tg AS MATERIALIZED (SELECT {a}k, s, s + CAST('0x' || substr(md5({name}k || ':' || s), 1, 15) AS BIGINT) % (n - 1 - s) AS t FROM sl, range(1, 1000) k(k), range(0, d) s(s)),
fy({a}k, s, ts, ws, r) AS (SELECT DISTINCT {a}k, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT) FROM tg
 UNION ALL SELECT {a}k, s + 1, list_prepend(t, ts), list_prepend(CASE WHEN list_contains(ts, s) THEN ws[list_position(ts, s)] ELSE s END, ws),
  CASE WHEN list_contains(ts, t) THEN ws[list_position(ts, t)] ELSE t END FROM fy JOIN tg USING ({a}k, s)),
dr AS MATERIALIZED (SELECT {a}k, s - 1 AS slot, r FROM fy WHERE s > 0),
sm AS (SELECT {"".join(f"x.{k}, " for k in keys.split(", ") if k)}x.unit_id, dr.k, sum(c.y[1]) AS s1, sum(c.y[len(c.y)]) AS s2
 FROM un x JOIN dr {on.replace("ON true", "ON slot < x.d")} JOIN pl c ON {both} AND c.pos = r + CASE WHEN r >= x.pos THEN 1 ELSE 0 END WHERE slot < x.d GROUP BY ALL),
mn AS (SELECT {a}[avg(y[1]), avg(y[len(y)])] AS mean, [sum(y[1]), sum(y[len(y)])] AS tot, [sum(y[1] * y[1]), sum(y[len(y)] * y[len(y)])] AS sq FROM pl GROUP BY ALL),
vr AS (SELECT {a}unit_id, v, n, d, y[v] AS y, near[v] AS near, mean[v] AS mean, tot[v] AS tot, sq[v] AS sq, CASE v WHEN 1 THEN s1 ELSE s2 END AS sim
 FROM sm JOIN un USING ({a}unit_id) JOIN mn {on}, range(1, 3) v(v)),
ct AS (SELECT {a}unit_id, v, n, d, y, near, mean, tot, sq, count(*) FILTER (sim >= near) AS more,
 count(*) FILTER (CASE WHEN y > mean THEN sim >= near WHEN y < mean THEN sim <= near ELSE true END) AS high FROM vr GROUP BY ALL)"""


_GSTAR = "(near / (tot - y) - d / CAST(n - 1 AS DOUBLE)) / (sqrt(d * (n - 1 - d) * ((sq - y * y) / (n - 1) - pow((tot - y) / (n - 1), 2)) / (CAST(n - 1 AS DOUBLE) * (n - 1) * (n - 2))) / ((tot - y) / (n - 1)))"
_P = "(least({0}, 999 - {0}) + 1) / 1e3"
_ONE = "m AS (SELECT unit_id, [value, value] AS y FROM zv)"


@query("s3_moran_local_permutations", f"""WITH RECURSIVE {_ONE}, {_drawn("", "")}
SELECT unit_id, value, {LOCAL}, {R(_P.format('high'), 6)} AS p_sim, COALESCE({_P.format('high')} < 0.05e0, false) AS significant
FROM zv LEFT JOIN lagged USING (unit_id) LEFT JOIN (SELECT unit_id, high FROM ct WHERE v = 1) USING (unit_id)""")
def _(spark, sf):
    return rounded(spatial.moran_local(values(spark, sf), b.edges(spark, sf), permutations=999))


@query("s4_getis_ord_local", f"""WITH RECURSIVE {_ONE}, {_drawn("", "")}, g AS (SELECT unit_id, near / (tot - y) AS g, {_GSTAR} AS z, {_P.format('more')} AS p FROM ct WHERE v = 1)
SELECT unit_id, {R('g', 6)} AS g, {R('z', 6)} AS z, {R('p', 6)} AS p_sim, CASE WHEN z > 1.96e0 AND p < 0.05e0 THEN 'hot' WHEN z < -1.96e0 AND p < 0.05e0 THEN 'cold' ELSE 'none' END AS spot FROM g""")
def _(spark, sf):
    return rounded(spatial.getis_ord_local(values(spark, sf), b.edges(spark, sf), permutations=999).drop("p_norm"))


@query("s5_spatial_correlogram", f"""WITH RECURSIVE walk(src, dst, d) AS (SELECT src, dst, 1 FROM ways UNION SELECT walk.src, ways.dst, d + 1 FROM walk JOIN ways ON ways.src = walk.dst WHERE d < 7),
al AS (SELECT min(d) AS ord, src, dst FROM walk WHERE src <> dst GROUP BY src, dst),
dg AS (SELECT ord, src, 1e0 / count(*) AS w FROM al GROUP BY ord, src), {_PERMUTED.format(draws=199)},
cr AS (SELECT ord, a.k, sum(a.z * c.z * w) AS c FROM al JOIN dg USING (ord, src) JOIN pz a ON a.unit_id = src JOIN pz c ON c.unit_id = dst AND c.k = a.k GROUP BY ord, a.k),
o AS (SELECT ord, c AS obs, (SELECT sum(z * z) FROM zv) AS z2, (SELECT count(*) FROM zv) AS n FROM cr WHERE k = 0),
lg AS (SELECT ord, (least(count(*) FILTER (c >= obs - 1e-9 * z2), count(*) FILTER (c < obs - 1e-9 * z2)) + 1) / 2e2 AS p FROM cr JOIN o USING (ord) WHERE k > 0 GROUP BY ord)
SELECT CAST(ord AS INT) AS "order", {R('n / s0 * obs / z2', 6)} AS moran_i, {R('p', 6)} AS p_sim, p < 0.05e0 AS significant
FROM o JOIN lg USING (ord) JOIN (SELECT ord, CAST(count(*) AS DOUBLE) AS s0 FROM dg GROUP BY ord) USING (ord)""")
def _(spark, sf):
    return rounded(spatial.spatial_correlogram(values(spark, sf), b.edges(spark, sf), 7, 199))


SCOPES = {"region": "region", "national": None}
_SCOPED = """sm0 AS (SELECT unit_id, 'region' AS scope, CAST(region AS VARCHAR) AS place, population FROM unit_frame UNION ALL SELECT unit_id, 'national', 'all', population FROM unit_frame),
m AS (SELECT scope, place, unit_id, [CAST(population AS DOUBLE), CAST(unit_id % 3 AS DOUBLE)] AS y FROM sm0)"""


def scoped(spark, sf):
    return b.unit_frame(spark, sf).withColumn("parity", F.col("unit_id") % 3)


@query("s6_autocorrelation_scopes", f"""WITH {_SCOPED},
zz AS MATERIALIZED (SELECT scope, place, unit_id, v, y[v] - avg(y[v]) OVER w AS z, count(*) OVER w AS n, row_number() OVER (w ORDER BY unit_id) - 1 AS pos
 FROM m, range(1, 3) v(v) WINDOW w AS (PARTITION BY scope, place, v)),
pm AS (SELECT scope, place, k, unit_id, row_number() OVER (PARTITION BY scope, place, k ORDER BY md5(scope || ':' || place || ':' || k || ':' || unit_id), unit_id) - 1 AS r FROM m, range(1, 1000) t(k)),
pz AS MATERIALIZED (SELECT pm.scope, pm.place, k, pm.unit_id, v, z FROM pm JOIN zz ON zz.scope = pm.scope AND zz.place = pm.place AND r = pos UNION ALL SELECT scope, place, 0, unit_id, v, z FROM zz),
pr AS (SELECT a.scope, a.place, src, dst, count(*) OVER (PARTITION BY a.scope, a.place, src) AS d FROM ways JOIN m a ON a.unit_id = src JOIN m c ON c.unit_id = dst AND c.scope = a.scope AND c.place = a.place),
cr AS (SELECT pr.scope, pr.place, a.v, a.k, sum(a.z * c.z / d) AS c FROM pr JOIN pz a ON a.scope = pr.scope AND a.place = pr.place AND a.unit_id = src
 JOIN pz c ON c.scope = pr.scope AND c.place = pr.place AND c.unit_id = dst AND c.k = a.k AND c.v = a.v GROUP BY ALL),
sz AS (SELECT scope, place, v, max(n) AS n, sum(z * z) AS z2 FROM zz GROUP BY ALL),
o AS (SELECT scope, place, v, c AS obs, z2, n FROM cr JOIN sz USING (scope, place, v) WHERE k = 0),
lg AS (SELECT scope, place, v, (least(count(*) FILTER (c >= obs - 1e-9 * z2), count(*) FILTER (c < obs - 1e-9 * z2)) + 1) / 1e3 AS p FROM cr JOIN o USING (scope, place, v) WHERE k > 0 GROUP BY ALL)
SELECT scope, place, CASE v WHEN 1 THEN 'population' ELSE 'parity' END AS variable, n, {R('n / s0 * obs / z2', 6)} AS moran_i, {R('p', 6)} AS p_sim
FROM o JOIN lg USING (scope, place, v) JOIN (SELECT scope, place, CAST(count(DISTINCT src) AS DOUBLE) AS s0 FROM pr GROUP BY ALL) USING (scope, place)""")
def _(spark, sf):
    return rounded(spatial.autocorrelation_scopes(scoped(spark, sf), b.edges(spark, sf), SCOPES, ["population", "parity"]))


@query("s6_local_scopes", f"""WITH RECURSIVE {_SCOPED}, {_drawn("scope, place", "scope || ':' || place || ':' || ")},
z2 AS (SELECT scope, place, v, sum(pow(y[v] - mean[v], 2)) AS z2 FROM pl JOIN mn USING (scope, place), range(1, 3) v(v) GROUP BY ALL),
g AS (SELECT *, {_GSTAR} AS g_z, {_P.format('more')} AS p_g, {_P.format('high')} AS p_moran FROM ct JOIN z2 USING (scope, place, v))
SELECT scope, place, CASE v WHEN 1 THEN 'population' ELSE 'parity' END AS variable, unit_id, {R('(n - 1) * (y - mean) * (near / d - mean) / z2', 6)} AS local_i,
 CASE WHEN y > mean AND near > d * mean THEN 1 WHEN y <= mean AND near > d * mean THEN 2 WHEN y <= mean THEN 3 ELSE 4 END AS quadrant,
 {R('p_moran', 6)} AS p_moran, p_moran < 0.05e0 AS significant, {R('g_z', 6)} AS g_z, {R('p_g', 6)} AS p_g,
 CASE WHEN g_z > 1.96e0 AND p_g < 0.05e0 THEN 'hot' WHEN g_z < -1.96e0 AND p_g < 0.05e0 THEN 'cold' ELSE 'none' END AS spot FROM g""")
def _(spark, sf):
    return rounded(spatial.local_scopes(scoped(spark, sf), b.edges(spark, sf), SCOPES, ["population", "parity"]))
