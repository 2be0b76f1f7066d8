"""Long tables are never sent whole to the driver, whatever Spark makes of their size."""

from pyspark.sql import functions as F

from hemicycle.checks import base, bridge, plan_queries  # noqa: F401
from hemicycle.functions.frames import small_side
from hemicycle.operators import geometry


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def _plans(spark, n):
    units = spark.range(n).select(F.col("id").alias("unit_id"))
    return units.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("plan_id"), "unit_id", (F.col("unit_id") % 3).alias("district"))


def test_plans_do_not_travel_to_a_long_unit_table(spark):
    units = spark.range(40).select(F.col("id").alias("unit_id"), (F.col("id") * 2).alias("population"))
    met = _plans(spark, 50).join(small_side(units, limit=10), "unit_id")
    assert _joins(met) == (0, 1)
    left = _plans(spark, 50).join(small_side(units, limit=10), "unit_id", "left")
    assert _joins(left) == (0, 1)
    short = _plans(spark, 50).join(small_side(units, limit=40), "unit_id")
    assert _joins(short) == (1, 0)
    assert met.agg(F.sum("population")).first()[0] == short.agg(F.sum("population")).first()[0] == 2 * 2 * sum(range(40))
    assert left.count() == 100 and left.where("population IS NULL").count() == 20


def test_vertices_do_not_travel_to_their_successors(spark):
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    ring = F.array(*[F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(i).alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(corners)])
    outlines = spark.range(30).select(F.col("id").alias("unit_id"), F.inline(ring))
    sides = geometry.segments(outlines)
    assert _joins(sides) == (0, 1)
    assert sides.count() == 90


def test_unit_tables_do_not_travel_to_each_other(spark, tmp_path):
    """Spark takes a table of ids for small by its file, so it would broadcast all units, orders or parts."""
    def put(name, df):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("nation", spark.range(2).selectExpr("cast(id as int) n_nationkey", "cast(0 as int) n_regionkey"))
    put("customer", spark.range(30).selectExpr("id c_custkey", "cast(id % 2 as int) c_nationkey"))
    put("orders", spark.range(60).selectExpr("id o_orderkey", "id % 20 o_custkey"))
    put("part", spark.range(4).selectExpr("id p_partkey", "concat('T', id % 2) p_type", "concat('B', id) p_brand"))
    put("lineitem", spark.range(240).selectExpr("id % 60 l_orderkey", "id % 4 l_partkey", "cast(1 as double) l_quantity"))
    people = bridge.population(spark, str(tmp_path))
    assert _joins(people) == (0, 1)
    assert {r.unit_id: r.population for r in people.collect()} == {u: 3 if u < 20 else 0 for u in range(30)}
    frame = bridge.unit_frame(spark, str(tmp_path))
    assert _joins(frame) == (1, 2)  # nations alone are broadcast
    assert frame.count() == 30 and frame.agg(F.sum("population")).first()[0] == 60
    votes = bridge.unit_votes(spark, str(tmp_path))
    assert _joins(votes) == (1, 1)  # few parts, counted
    assert votes.agg(F.sum("votes")).first()[0] == 240
    districts = bridge.district_votes(spark, str(tmp_path))
    assert _joins(districts) == (1, 2)
    assert {(r.district, r.party): r.votes for r in districts.collect()} == {(d, f"B{b}"): 60 for d in (0, 1) for b in (d, d + 2)}


def test_hulls_and_circles_do_not_travel_to_their_units(spark, tmp_path):
    """A stored table counts as small too; one row a unit grows with the units."""
    spark.range(12).selectExpr("id c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("g4_convex_hull_ratio", "g5_reock"):
        out = base.QUERIES[name](spark, str(tmp_path))
        assert _joins(out)[0] == 0, name
        assert out.count() == 12
    out = geometry.compactness(bridge.shapes(spark, str(tmp_path)))
    assert _joins(out)[0] == 0
    assert out.where("reock BETWEEN 0 AND 1 AND convex_hull_ratio BETWEEN 0 AND 1.000001").count() == 12
