"""Times the per-plan metrics on a long ensemble and prints one JSON line.

PLANS plans (default 50000) of the first UNITS customers (default 451) of
BENCH_SF_DIR, eight districts each: every metric covers every plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hemicycle.checks import bridge as b  # noqa: E402
from hemicycle.operators import geometry, graph, integrity  # noqa: E402
from hemicycle.plans import metrics, shape  # noqa: E402
from hemicycle.session import cut_lineage, local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    n_plans, n_units = int(os.environ.get("PLANS", 50_000)), int(os.environ.get("UNITS", 451))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "20g", 32)
    first = F.col("unit_id") < n_units
    units = cut_lineage(b.unit_frame(spark, folder).where(first))
    votes = cut_lineage(b.unit_votes(spark, folder).where(first))
    vertices = cut_lineage(b.vertices(spark, folder).where(first))
    edges = cut_lineage(graph.adjacency(vertices, "rook"))
    measures, borders = cut_lineage(geometry.area_perimeter(vertices)), cut_lineage(geometry.shared_borders(vertices))
    u, p = F.col("unit_id"), F.col("plan_id")
    plans = (
        spark.range(n_plans, numPartitions=32).select(F.col("id").cast("int").alias("plan_id"))
        .withColumn("unit_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_units - 1).cast("long"))))
        .withColumn("district", F.pmod(F.floor(u / 57) + F.pmod(F.xxhash64(u, p), F.lit(7)) % 2 + p % 3, F.lit(8)).cast("int"))
    )
    path = os.environ.get("PLANS_PATH", f"{spark.sparkContext.getCheckpointDir()}/bench-plans")
    plans.write.mode("overwrite").parquet(path)
    plans = spark.read.parquet(path)
    jobs = {
        "max_deviation": lambda: integrity.max_deviation(plans, units),
        "splits": lambda: integrity.split_measures(plans, units, ["commune"]),
        "cut_edges": lambda: graph.cut_edges(edges, plans),
        "compactness": lambda: shape.plan_compactness(shape.dissolve(plans, measures, borders)),
        "electoral": lambda: metrics.plan_electoral_metrics(plans, votes, units, total=44),
    }
    times = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
    total = sum(times.values())
    print(json.dumps({"metric": "plan_metrics_seconds", "value": round(total, 2), "unit": "sec", "jobs": times,
                      "plans": n_plans, "rows": n_plans * n_units, "plans_per_second": round(n_plans / total)}))


if __name__ == "__main__":
    main()
