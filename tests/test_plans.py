"""Plan-shape tests: the physical properties the design relies on at scale."""

import re

import pytest

from documents_fixture import SENSORS, VALID_1, VALID_2, write_docs
from fieldsense.operators.dedup import dedup_first
from fieldsense.operators.lookup import add_location
from fieldsense.plans import queries as Q
from fieldsense.streaming.ingest import ingest_folder
from fieldsense.schema import MEASUREMENT_SCHEMA, sensor_dim
from fieldsense.sources.table import read_series, read_table


def plan(df) -> str:
    """The formatted explain text (operators plus full scan details)."""
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def final_plan(df) -> str:
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("plans")
    inbox = write_docs(str(base / "inbox"), {"a.json": VALID_1, "b.json": VALID_2})
    path = str(base / "table")
    ingest_folder(spark, inbox, path, SENSORS)
    return path


def empty(spark):
    return spark.createDataFrame([], MEASUREMENT_SCHEMA)


def test_latest_status_limits_before_shuffle(spark):
    p = plan(Q.latest_status(empty(spark)))
    assert p.count("WindowGroupLimit") >= 2          # partial (map side) and final


def test_dedup_first_limits_map_side(spark):
    m = empty(spark)
    p = plan(dedup_first(m.withColumn("seq", m.sensor_id), ["seq"]))
    assert p.count("WindowGroupLimit") >= 2


def test_latest_status_on_table_prunes_partitions_at_run_time(spark, stored):
    p = final_plan(Q.latest_status(read_table(spark, stored)))
    assert "array_contains(Subquery" in p or "array_contains(scalar-subquery" in p
    assert "PartitionFilters: [isnotnull(window_date" in p
    assert "ReusedExchange" in p                     # the group maximum is computed once


def test_latest_status_with_series_catalog_reads_no_unpruned_table(spark, stored):
    m, series = read_table(spark, stored), read_series(spark, stored)
    df = Q.latest_status(m, series)
    assert sorted(map(str, df.collect())) == sorted(map(str, Q.latest_status(m).collect()))
    scans = re.findall(r"Location: [^\[]*\[([^\]]*)\]\n(.*)", plan(df))
    assert {"_series" in where for where, _ in scans} == {True, False}
    assert all("PartitionFilters" in more for where, more in scans if "_series" not in where)


def test_range_queries_push_filters_to_scan(spark, stored):
    m = read_table(spark, stored)
    p = plan(Q.connectivity_stats(m, "2026-01-01 00:00:00", "2026-01-01 23:59:59", locations=["Garden 1"]))
    assert "PartitionFilters: [isnotnull(window_date" in p and "(window_date" in p
    assert "GreaterThanOrEqual(window_start" in p and "EqualTo(location,Garden 1)" in p
    assert "partial_sum(received_packets" in p
    fetch = plan(Q.fetch_measurements(m, "2026-01-01 00:00:00", "2026-01-01 23:59:59"))
    assert "hashpartitioning" not in fetch and "rangepartitioning(window_start" in fetch


def test_location_lookup_is_one_join_without_exchange(spark):
    p = plan(add_location(empty(spark).drop("location"), SENSORS))
    assert p.count("BroadcastHashJoin") >= 1 and "hashpartitioning" not in p


def test_dimension_join_is_broadcast_by_size(spark):
    dim = sensor_dim(spark, SENSORS)
    facts = empty(spark).drop("location")
    assert "BroadcastHashJoin" in plan(add_location(facts, dim))       # exact small statistics
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # no size may be broadcast
        assert "BroadcastHashJoin" not in plan(add_location(facts, dim))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_silent_sensors_single_anti_join_sized_by_spark(spark):
    p = plan(Q.silent_sensors(empty(spark), sensor_dim(spark, SENSORS), "2026-01-02 00:00:00"))
    assert "LeftAnti" in p and "LeftSemi" not in p
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        p = plan(Q.silent_sensors(empty(spark), sensor_dim(spark, SENSORS), "2026-01-02 00:00:00"))
        assert "BroadcastHashJoin" not in p                           # no hint forces a broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_silence_alerts_scan_once(spark, stored):
    p = final_plan(Q.sensor_gaps(read_table(spark, stored), sensor_dim(spark, SENSORS), "2026-01-01 12:00:00"))
    final = p.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert len(set(re.findall(r"Scan parquet\s+\((\d+)\)", final))) == 1      # one scan node


def test_insert_reads_exact_dates_and_never_shuffles_the_stored_side(spark, stored):
    import datetime as dt
    from fieldsense.operators.dedup import insert_if_absent
    table = read_table(spark, stored)
    batch = (spark.range(3).selectExpr("id AS seq", "id + 1 AS sensor_id", "id + 1 AS treatment_id",
                                       "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, id) AS window_start"))
    df = insert_if_absent(batch, table, ["seq"], dates=[dt.date(2026, 1, 1), dt.date(2026, 3, 5)])
    p = plan(df)
    assert re.search(r"PartitionFilters: \[.*window_date#\d+ IN \(2026-01-01,2026-03-05\)", p)
    # the semi join from the scan: its other side is broadcast, no exchange lies between scan and join
    tree = p.split("\n\n")[0]
    at = tree.index("Scan parquet")
    above = tree[:at].splitlines()[::-1]
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert "BroadcastHashJoin LeftSemi" in above[join] and not any("Exchange" in line for line in above[:join])
    assert {r.sensor_id for r in df.collect()} == {2, 3}


def test_small_outputs_are_sorted_once(spark):
    from fieldsense.plans import series as S
    m = empty(spark)
    bars = S.connectivity_series(Q.connectivity_rows(m, "2026-01-01", "2026-01-02"))
    assert plan(bars).count("rangepartitioning") == 1
    assert plan(S.temperature_series(m)).count("rangepartitioning") == 1
    assert plan(S.filter_options(m, ["A"], [1])).count("rangepartitioning") == 1
    lines = S.alert_lines(Q.gap_rows(m, sensor_dim(spark, SENSORS), "2026-01-02"))
    assert "SinglePartition" not in plan(lines) and "rangepartitioning" not in plan(lines)


def test_positions_are_numbered_by_several_tasks(spark):
    from pyspark.sql import functions as F

    from fieldsense.plans.catalog import _positions
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.range(1000).select((F.col("id") * 7919 % 1000 + 5).alias("v")).orderBy("v")
        rows = _positions(df, "v").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, was)
    assert sorted((r.place, r.v) for r in rows) == [(i + 1, i + 5) for i in range(1000)]
    assert len({r.task for r in rows}) > 1
    assert _positions(df.limit(0), "v").collect() == []
