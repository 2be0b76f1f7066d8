"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set
the data and the cores. Every query is written to the ``noop`` sink, which
computes all rows and columns without collecting them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hemicycle.checks.catalogue import QUERIES  # noqa: E402
from hemicycle.session import local_session  # noqa: E402

HEADLINE = [
    "e1_dhondt", "e6_run_plan_two_level", "e8_magnitudes_by_plan", "f14_compare_plans",
    "f16_plan_electoral_metrics", "f17_electoral_ensemble", "q2_fair_share_district",
    "p3_max_deviation", "p4_cut_edges", "p12_multi_level_split_metrics", "p14_position_plans",
    "g6_dissolve", "h1_adjacency_rook", "s2_moran_global", "d5_import_candidates",
    "i1_compare_ensembles", "i4_pareto_2d", "i7_compare_sensitivity", "k3_gelman_rubin", "d12_dist_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
