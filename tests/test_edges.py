"""Edges the driver data does not have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from documents_fixture import SENSORS
from fieldsense.functions.time import expected_windows, time_floor
from fieldsense.operators.validate import parse_documents, validate_documents
from fieldsense.plans import queries as Q
from fieldsense.plans import series as S
from fieldsense.schema import MEASUREMENT_SCHEMA, sensor_dim

T0 = dt.datetime(2026, 1, 1)


def measurements(spark, rows):
    full = [(s, t, loc, w, w + dt.timedelta(minutes=15), 15, 20.0, 21.0, 15, 15, 1.0) for s, t, loc, w in rows]
    return spark.createDataFrame(full, MEASUREMENT_SCHEMA)


def test_series_title_does_not_hang_on_the_input_order(spark):
    rows = [(1, 1, "B", T0), (1, 2, "A", T0)]
    for given in (rows, rows[::-1]):
        stats = Q.connectivity_rows(measurements(spark, given), "2026-01-01", "2026-01-02")
        assert {r.series for r in S.connectivity_series(stats).collect()} == {"Sensor 1 (A)"}


def test_now_with_fractions(spark):
    now = dt.datetime(2026, 1, 2, 12, 0, 0, 500000)
    edge = measurements(spark, [(1, 1, "A", dt.datetime(2026, 1, 1, 12, 0, 0)), (1, 1, "A", dt.datetime(2026, 1, 2, 11, 59))])
    got = Q.max_gap(edge, now).collect()
    assert len(got) == 1 and got[0].last_seen == dt.datetime(2026, 1, 2, 11, 59)
    # the row at the edge of the second counts; the gap before the last row is 23:59:00 to the microsecond
    assert got[0].max_gap_s == 86340
    late = measurements(spark, [(1, 1, "A", dt.datetime(2026, 1, 2, 9, 0, 1))])
    # 10,799.5 s since the last row: not three hours; the range start lies further back
    exact = Q.max_gap(late, now).collect()[0]
    assert exact.max_gap_s == 75600 and Q.gap_rows(late, sensor_dim(spark, []), now, threshold_hours=21.001).count() == 0
    steps = [(1, 1, "A", dt.datetime(2026, 1, 1, 12, 0, 1) + dt.timedelta(hours=h)) for h in range(0, 22)]
    assert Q.gap_rows(measurements(spark, steps), sensor_dim(spark, []), now).count() == 0


def test_floor_keeps_null_times_and_nests(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-01 07:20:10' AS t UNION ALL SELECT CAST(NULL AS timestamp_ntz)")
    got = df.select(time_floor(time_floor(F.col("t"), "15 minutes"), "6 hours").alias("a"),
                    time_floor(F.col("t"), "15 minutes").alias("b")).collect()
    assert len(got) == 2 and {(r.a, r.b) for r in got} == {
        (None, None), (dt.datetime(2026, 1, 1, 6), dt.datetime(2026, 1, 1, 7, 15))}
    old = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59' AS t").select(time_floor(F.col("t"), "1 hour")).first()[0]
    assert old == dt.datetime(1969, 12, 31, 23)


def test_frequency_as_a_duration():
    assert expected_windows("2026-01-01 00:00:00", "2026-01-01 00:05:00", dt.timedelta(seconds=30)) == 11
    assert expected_windows("2026-01-01 00:00:00", "2026-01-01 01:00:00", 15) == 5


def test_last_of_a_repeated_member_counts(spark):
    text = '''{"site_id": 1, "site_id": 7, "window_start": "2026-01-01", "window_end": "2026-01-01",
               "n_observations": 1, "treatments": [{"treatment_id": 1, "mean_control_temp": 1, "mean_control_temp": 2,
               "mean_treatment_temp": 1, "received_packets": 1, "expected_packets": 1, "connection_quality": 1}]}'''
    old = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        r = validate_documents(parse_documents(spark.createDataFrame([("f", text)], "file_name string, value string"))).first()
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", old)
    assert r.error is None and r.sensor_id == 7 and r["items"][0]["mean_control_temp"] == 2.0


def test_silent_sensors_compare_distinct_ids(spark):
    m = measurements(spark, [(1, t, "A", T0) for t in range(50)])
    plan = Q.silent_sensors(m, sensor_dim(spark, SENSORS), T0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [sensor_id" in plan
    assert [r.sensor_id for r in Q.silent_sensors(m, sensor_dim(spark, SENSORS), T0).collect()] == [9]


def test_alert_lines_and_the_line(spark):
    m = measurements(spark, [(1, 1, "A", T0)])
    alerts = Q.gap_rows(m, sensor_dim(spark, SENSORS), T0 + dt.timedelta(hours=4))
    assert S.alert_lines(alerts).count() == 2
    line = S.gap_alert_text(alerts).first()
    assert line.n_alerts == 2 and line.text.count("; ") == 1


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from fieldsense import session

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None
        def getConf(self): return {}

    class Session:
        sparkContext = Context()
        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
