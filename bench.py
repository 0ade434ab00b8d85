"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]. Prints ONE JSON line.

Each query is executed to completion with the ``noop`` sink (full computation, nothing
collected). The ETL query writes the derived table once; the cross-filter queries then run
over that saved table, the way the dashboard queries a finished run; ``crossfilter_bundle`` is the whole
document from the summary cube, ``bundle_from_rows`` the five surfaces from the rows. The whole suite runs
once untimed on $BENCH_WARM_DIR (default sf0.01) first, to warm the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tallyframe.operators import cube as CB
    from tallyframe.operators import metrics as M
    from tallyframe.plans import catalog
    from tallyframe.plans.retail import derived_table, save_derived
    from tallyframe.session import local_session, scratch_path

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2), app="tallyframe-bench")
    Q = catalog.QUERIES

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        fn()
        timings[name] = round(time.perf_counter() - t, 3)

    f = M.Filters(date_from="1996-01-01", date_to="1996-12-31", category="MEDIUM", region="R2")
    names = ("clean_stats", "join_stats", "schema_contract", "profile_samples", "verify_checks",
             "run_summary", "contract_violations", "edge_closure", "stream_task_status")

    def suite(sf: str, clock) -> None:
        saved = {}

        def etl():
            saved["df"] = save_derived(derived_table(spark, sf), scratch_path(spark, "bench-derived"))

        clock("etl_clean_join_derive", etl)
        d = saved["df"]
        clock("kpis", lambda: run(M.kpis(d)))
        clock("revenue_by_category", lambda: run(M.revenue_by_category(d)))
        clock("revenue_over_time", lambda: run(M.revenue_over_time(d)))
        clock("revenue_by_region", lambda: run(M.revenue_by_region(d)))
        clock("top_products", lambda: run(M.top_products(d)))
        clock("bundle_from_rows", lambda: [run(x) for x in M.aggregate(d, f).surfaces().values()])
        cube = scratch_path(spark, "bench-cube")
        clock("cube_refresh", lambda: CB.refresh(d, cube, "1"))
        clock("crossfilter_bundle", lambda: run(CB.document(CB.read_cube(spark, cube), f)))
        clock("grouping_sets_cut", lambda: run(M.grouping_sets_cut(d, f)))
        for name in names:
            clock(name, lambda name=name: run(Q[name](spark, sf)))

    # Warm-up: every timed query once on a smaller scale factor (JIT of the generated code,
    # class loading), so the timings describe a running cluster rather than a cold JVM.
    # Nothing is reused across scale factors: every run reads its own inputs and writes its
    # own scratch tables.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    suite(warm_dir, lambda _name, fn: fn())
    suite(sf_dir, timed)

    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rstrip("/").split("sf")[-1],
        "spark": spark.version,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
