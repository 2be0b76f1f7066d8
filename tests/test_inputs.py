"""Stored plans and election inputs: rows are dealt to tasks, inputs are read once."""

from pyspark.sql import functions as F

from hemicycle.checks import ingest_queries
from hemicycle.sources import store


def test_plans_of_one_task_are_written_by_several(spark, tmp_path):
    rows = spark.range(0, 600, numPartitions=1)
    plans = rows.select(
        F.concat(F.lit("run"), F.col("id") % 2).alias("run_id"), F.lit("free").alias("scenario"), F.lit(1).alias("chain_id"), (F.col("id") % 3).alias("draw"),
        F.when(F.col("id") != 7, F.col("id").cast("string")).alias("unit_id"), (F.col("id") % 5).alias("district"))
    store.write_plans(plans, str(tmp_path / "plans"))
    assert len(list((tmp_path / "plans" / "run_id=run0" / "scenario=free").glob("part-*"))) > 1
    back = store.read_plans(spark, str(tmp_path / "plans"))
    assert set(back.columns) == {"run_id", "scenario", "chain_id", "draw", "unit_id", "district"}
    wanted = {(f"run{i % 2}", i % 3, str(i), i % 5) for i in range(600) if i != 7}
    assert {tuple(r) for r in back.select("run_id", "draw", "unit_id", "district").collect()} == wanted and back.count() == 599


def test_election_inputs_are_read_once(spark, tmp_path):
    def put(name, columns, rows):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("nation", "n_nationkey int, n_regionkey int", [(0, 0), (1, 1)])
    put("customer", "c_custkey long, c_nationkey int", [(i, i % 2) for i in range(6)])
    put("orders", "o_orderkey long, o_custkey long", [(i, i % 6) for i in range(12)])
    put("part", "p_partkey long, p_brand string", [(i, f"Brand#{i % 3 + 11}") for i in range(9)])
    put("lineitem", "l_orderkey long, l_partkey long, l_quantity double", [(i % 12, i % 9, float(i % 5 + 1)) for i in range(60)])
    people, _, mags, pact = ingest_queries._elected(spark, str(tmp_path))
    for part in (people, mags, pact):
        assert "FileScan" not in part._jdf.queryExecution().executedPlan().toString()
    assert people.agg(F.sum("votes")).first()[0] == sum(i % 5 + 1 for i in range(60))
    assert {tuple(r) for r in mags.collect()} == {(0, 30), (1, 30)}
