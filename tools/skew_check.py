"""Skew experiment: one key holds a third of all rows.

usage: python tools/skew_check.py [sf_dir]

Reshapes ``events`` into readings and makes two skewed inputs:

* hot key: every third row gets the same key (sensor 1, treatment 1, one
  window) -> ``dedup_first`` (and, for comparison, ``row_number() = 1``);
* hot group: every third row gets location 'Site 1' and treatment 1 but
  keeps its own time -> ``latest_status`` (one group holds a third of the
  rows).

Runs them with Spark's event log in a scratch folder and prints per
shuffle-reading stage the total and the largest per-task shuffle records
read: with map-side reduction the largest task stays small; without it one
task would receive the hot third of the rows.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from fieldsense.operators.dedup import dedup_first
    from fieldsense.plans import queries as Q
    from fieldsense.session import build_session
    from fieldsense.sources import events as E
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false",
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    raw = E.raw_measurements(spark, sf_dir)
    hot = F.col("event_id") % 3 == 0
    skewed = raw.select(
        "event_id",
        F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("sensor_id")).alias("sensor_id"),
        F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("treatment_id")).alias("treatment_id"),
        F.when(hot, F.lit("Site 1")).otherwise(F.col("location")).alias("location"),
        F.when(hot, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).otherwise(F.col("window_start"))
        .alias("window_start"),
        *[c for c in raw.columns if c not in ("event_id", "sensor_id", "treatment_id", "location", "window_start")])
    hot_group = raw.select(
        F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("sensor_id")).alias("sensor_id"),
        F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("treatment_id") + 1).alias("treatment_id"),
        F.when(hot, F.lit("Site 1")).otherwise(F.col("location")).alias("location"),
        F.when(hot, F.col("window_start")).otherwise(F.col("window_start") - F.expr("INTERVAL 1 DAY"))
        .alias("window_start"),
        *[c for c in raw.columns if c not in ("event_id", "sensor_id", "treatment_id", "location", "window_start")])
    n = skewed.count()
    jobs = {}

    def run(label, df):
        spark.sparkContext.setJobGroup(label, label)
        df.write.format("noop").mode("overwrite").save()
        jobs[label] = None

    run("dedup_first (min_by aggregate)", dedup_first(skewed, ["event_id"]))
    w = Window.partitionBy("sensor_id", "treatment_id", "window_start").orderBy("event_id")
    run("row_number dedup (for comparison)",
        skewed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))
    run("latest_status on a hot group", Q.latest_status(hot_group))
    spark.stop()

    paths = sorted(p for p in glob.glob(f"{log_dir}/**/*", recursive=True)
                   if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus"))
    lines = [line for path in paths for line in open(path, encoding="utf-8")]
    stage_group, reads = {}, {}
    for line in lines:
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            g = e.get("Properties", {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                stage_group[s] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            if r:
                reads.setdefault(e["Stage ID"], []).append(r)
    print(f"rows: {n}; rows of the hot key / hot group: about {n // 3}")
    for label in jobs:
        for sid in sorted(s for s, g in stage_group.items() if g == label and s in reads):
            rs = reads[sid]
            print(f"{label:36s} stage {sid:3d}: tasks={len(rs):3d} shuffle records total={sum(rs):7d} "
                  f"largest task={max(rs):7d}")


if __name__ == "__main__":
    main()
