"""Print the physical plans of the headline queries on a stored table.

usage: python tools/explain_plans.py [sf_dir] [--full]
Builds a date-partitioned measurements table from ``events`` in a scratch
folder under spark.checkpoint.dir, runs each headline query once and prints
a digest of the executed (adaptive) plan: operators, exchanges, join
strategies, scan partition / pushed filters and read schema. ``--full``
prints the whole formatted plan instead.
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"(Exchange|Join|Aggregate|Window|WindowGroupLimit|Scan parquet|Sort |Union|Generate|"
                  r"PartitionFilters|PushedFilters|ReadSchema|Subquery|BroadcastExchange|TakeOrdered)")


def main() -> None:
    args = sys.argv[1:]
    sf_dir = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    full = "--full" in args
    from fieldsense.plans import catalog as C
    from fieldsense.plans import queries as Q
    from fieldsense.session import build_session, ensure_checkpoint_dir
    from fieldsense.sources import events as E
    from fieldsense.sources.table import append_new, read_table
    spark = build_session()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plans-table-{uuid.uuid4().hex}"
    append_new(E.raw_measurements(spark, sf_dir), path, order_by=["event_id"])
    m = read_table(spark, path)
    plans = {
        "latest_status": Q.latest_status(m),
        "connectivity_6h": Q.connectivity_stats(m, *C.RANGE_6H, locations=["Site 1", "Site 2", "Unknown"],
                                                sensor_ids=[1, 3, 4, 8]),
        "sensor_gaps": Q.sensor_gaps(m, E.fixture_sensors(spark), C.NOW),
        "gap_stats": Q.gap_stats(m, C.START, C.END),
        "fetch_measurements": Q.fetch_measurements(m, C.START, C.END, locations=["Site 2", "Unknown"],
                                                   treatment_ids=[2, 3], min_quality=0.5),
        "dedup_first (events)": E.measurements(spark, sf_dir),
    }
    for name, df in plans.items():
        df.collect()
        print(f"===== {name}")
        if full:
            df.explain("formatted")
            continue
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        for line in final.splitlines():
            if KEEP.search(line):
                line = re.sub(r"#\d+L?", "", line)
                line = re.sub(r", \[plan_id=\d+\]", "", line)
                print(line.rstrip()[:170])
    spark.stop()


if __name__ == "__main__":
    main()
