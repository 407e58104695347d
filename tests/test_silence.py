"""Running silence alerts against the batch query and a plain count."""

import datetime as dt
import random

from fieldsense.plans.queries import sensor_gaps
from fieldsense.schema import MEASUREMENT_SCHEMA, sensor_dim
from fieldsense.streaming.silence import start_alerts

T0 = dt.datetime(2026, 1, 1)
ROWS = MEASUREMENT_SCHEMA.simpleString()[7:-1]
DDL = "sensor_id bigint, location string, last_seen timestamp_ntz, alert_at timestamp_ntz"


def row(sensor, minute, treatment=1, location="A"):
    ws = T0 + dt.timedelta(minutes=minute)
    return (sensor, treatment, location, ws, ws + dt.timedelta(minutes=15), 15, 1.0, 2.0, 14, 15, 0.5)


def run(spark, tmp_path, drops, threshold_hours, delay):
    inbox, out, ledger = (str(tmp_path / n) for n in ("rows", "alerts", "ledger"))
    for drop in drops:
        spark.createDataFrame(drop, ROWS).coalesce(1).write.mode("append").parquet(inbox)
        start_alerts(spark.readStream.schema(MEASUREMENT_SCHEMA).parquet(inbox), out, ledger, threshold_hours,
                     delay).awaitTermination()
    return sorted((r.sensor_id, r.location, r.last_seen, r.alert_at) for r in spark.read.schema(DDL).parquet(out).collect())


def test_late_rows_within_the_delay_fill_gaps(spark, tmp_path):
    """Sensor 2 seems silent until its rows come late; sensor 3 is."""
    first = [row(1, m) for m in range(0, 240, 15)] + [row(2, 0), row(3, 0), row(3, 15, 2)]
    late = [row(1, 240)] + [row(2, m) for m in range(15, 240, 15)]
    far = [row(1, m) for m in range(255, 700, 15)] + [row(2, m) for m in range(240, 700, 15)]
    got = run(spark, tmp_path, [first, late, far], 2, "3 hours")
    at = T0 + dt.timedelta(minutes=15)
    assert got == [(3, "A", at, at + dt.timedelta(hours=2))]


def test_a_stream_that_falls_silent_equals_the_batch_alerts(spark, tmp_path):
    rnd, rows = random.Random(4), []
    stop = {1: 20 * 60, 2: 9 * 60, 3: 16 * 60 + 45, 4: 17 * 60, 5: 20 * 60}
    for sensor, end in stop.items():
        rows += [row(sensor, m, t, f"Site {sensor % 2}") for m in range(0, end, 15) for t in (1, 2)
                 if rnd.random() < 0.9 or m % 60 == 0]
    rnd.shuffle(rows)
    by_time = sorted(rows, key=lambda r: r[3])
    last = max(r[3] for r in rows)
    got = run(spark, tmp_path, [by_time[:len(rows) // 2], by_time[len(rows) // 2:]], 3, "0 seconds")
    seen: dict = {}
    for r in rows:
        seen.setdefault((r[0], r[2]), set()).add(r[3])
    three = dt.timedelta(hours=3)
    plain = sorted((*k, p, p + three) for k, points in seen.items() for p in points
                   if p + three <= last and not any(p < q < p + three for q in points))
    assert got == plain and {g[0] for g in got} == {2, 3, 4} - {s for s in (4,) if max(seen[4, "Site 0"]) + three > last}
    # the same sensors as the batch query at the same instant
    batch = sensor_gaps(spark.createDataFrame(rows, ROWS),
                        sensor_dim(spark, [{"id": s, "location": f"Site {s % 2}"} for s in stop]), last, 3, hours=19)
    assert {(r.sensor_id, r.location) for r in batch.collect()} == {g[:2] for g in got}


def test_empty_and_null_rows(spark, tmp_path):
    rows = [row(None, 0), (1, 1, None, None, None, 15, 1.0, 2.0, 1, 1, 0.5), row(1, 0, location=None), row(2, 600)]
    got = run(spark, tmp_path, [rows], 1, "0 seconds")
    assert got == [(1, None, T0, T0 + dt.timedelta(hours=1))]
