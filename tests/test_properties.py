"""Property tests: the operators against brute-force Python on random small
tables (hot keys, ties and duplicates on purpose)."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldsense.operators.dedup import dedup_first, insert_if_absent
from fieldsense.plans import queries as Q
from fieldsense.schema import MEASUREMENT_SCHEMA

T0 = dt.datetime(2026, 1, 1)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

row = st.tuples(
    st.integers(1, 3),                  # sensor: few values -> hot keys
    st.integers(1, 2),                  # treatment
    st.sampled_from(["A", "B"]),        # location
    st.integers(0, 24 * 4),             # window index (15 min) within one day
    st.integers(0, 20),                 # received
    st.integers(0, 20),                 # expected
    st.integers(0, 128),                # quality * 128
)


def to_rows(raw):
    out = []
    for seq, (s, t, loc, w, rec, exp, q) in enumerate(raw):
        ws = T0 + dt.timedelta(minutes=15 * w)
        out.append((s, t, loc, ws, ws + dt.timedelta(minutes=15), 15, float(seq), float(seq) + 1.5,
                    rec, exp, q / 128.0, seq))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, MEASUREMENT_SCHEMA.simpleString()[7:-1] + ", seq bigint")


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_dedup_first_is_first_by_order(spark, raw):
    rows = to_rows(raw)
    first = {}
    for r in sorted(rows, key=lambda r: r[-1]):
        first.setdefault((r[0], r[1], r[3]), r)
    got = {(r.sensor_id, r.treatment_id, r.window_start): tuple(r)
           for r in dedup_first(frame(spark, rows), ["seq"]).collect()}
    assert got == first


@SETTINGS
@given(st.lists(row, min_size=1, max_size=30), st.lists(row, min_size=1, max_size=30))
def test_insert_if_absent_is_key_difference(spark, stored_raw, batch_raw):
    stored, batch = to_rows(stored_raw), to_rows(batch_raw)
    stored_keys = {(r[0], r[1], r[3]) for r in stored}
    first = {}
    for r in sorted(batch, key=lambda r: r[-1]):
        first.setdefault((r[0], r[1], r[3]), r)
    want = {k: v for k, v in first.items() if k not in stored_keys}
    got = {(r.sensor_id, r.treatment_id, r.window_start): tuple(r)
           for r in insert_if_absent(frame(spark, batch), frame(spark, stored), ["seq"]).collect()}
    assert got == want


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_max_gap_brute_force(spark, raw):
    rows = to_rows(raw)
    now = T0 + dt.timedelta(hours=24)
    lo = now - dt.timedelta(hours=24)
    pts = defaultdict(set)
    for r in rows:
        if lo <= r[3] <= now:
            pts[(r[0], r[2])].add(r[3])
    want = {}
    for k, p in pts.items():
        seq = [lo] + sorted(p) + [now]
        want[k] = int(max((b - a).total_seconds() for a, b in zip(seq, seq[1:])))
    got = {(r.sensor_id, r.location): r.max_gap_s for r in Q.max_gap(frame(spark, rows).drop("seq"), now).collect()}
    assert got == want


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_connectivity_brute_force(spark, raw):
    rows = to_rows(raw)
    start, end = T0, T0 + dt.timedelta(hours=20)
    acc = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        if start <= r[3] <= end:
            b = r[3].replace(minute=0)
            a = acc[(b, r[0], r[2])]
            a[0] += r[8]; a[1] += r[9]; a[2] += r[10]; a[3] += 1
    want = {k: (a[0], a[1], a[2] / a[3], min(a[0] / max(a[1], 1), 1.0)) for k, a in acc.items()}
    got = {(r.time_bin, r.sensor_id, r.location): (r.received_count, r.expected_count, r.avg_quality, r.ratio)
           for r in Q.connectivity_stats(frame(spark, rows).drop("seq"), start, end).collect()}
    assert got == want


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_latest_status_brute_force(spark, raw):
    rows = to_rows(raw)
    mx = {}
    for r in rows:
        k = (r[2], r[1])
        mx[k] = max(mx.get(k, r[3]), r[3])
    want = sorted((r[2], r[1], r[0], r[3]) for r in rows if r[3] == mx[(r[2], r[1])])
    got = sorted((r.location, r.treatment_id, r.sensor_id, r.window_start)
                 for r in Q.latest_status(frame(spark, rows).drop("seq")).collect())
    assert got == want


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40), st.integers(0, 24 * 4), st.integers(0, 24 * 4))
def test_gap_stats_brute_force(spark, raw, a, b):
    rows = to_rows(raw)
    lo, hi = T0 + dt.timedelta(minutes=15 * min(a, b)), T0 + dt.timedelta(minutes=15 * max(a, b), seconds=59)
    expected = int((hi - lo).total_seconds() / 900) + 1
    counts = defaultdict(int)
    for r in rows:
        if lo <= r[3] <= hi:
            counts[(r[0], r[1], r[2])] += 1
    want = {k: (expected, c, max(expected - c, 0)) for k, c in counts.items()}
    got = {(r.sensor_id, r.treatment_id, r.location): (r.expected_count, r.actual_count, r.missing_count)
           for r in Q.gap_stats(frame(spark, rows).drop("seq"), lo, hi).collect()}
    assert got == want


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_control_series_brute_force(spark, raw):
    from fieldsense.plans.series import control_series
    rows = to_rows(raw)
    best = {}
    for r in rows:
        k = (r[0], r[3])
        if k not in best or (r[1], r[6]) < best[k][0]:
            best[k] = ((r[1], r[6]), r[6])
    # ties on the lowest treatment: any of their control values is allowed
    got = {(r.sensor_id, r.window_start): r.value for r in control_series(frame(spark, rows).drop("seq")).collect()}
    assert set(got) == set(best)
    for k, v in got.items():
        lowest = min(r[1] for r in rows if (r[0], r[3]) == k)
        assert v in {r[6] for r in rows if (r[0], r[3]) == k and r[1] == lowest}
