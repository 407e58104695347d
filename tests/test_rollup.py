"""Rollup and window coverage: equal to the batch queries over any range, only the
days of a commit change, commits cut short or repeated change nothing."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldsense.plans.queries import connectivity_stats, gap_stats
from fieldsense.schema import MEASUREMENT_SCHEMA
from fieldsense.sources import coverage as C
from fieldsense.sources import rollup as R
from fieldsense.sources.daystore import DayStore
from fieldsense.streaming.connectivity import maintain

T0 = dt.datetime(2026, 1, 1)
DDL = MEASUREMENT_SCHEMA.simpleString()[7:-1]


def cells(seed, n=700, days=5, off_grid=0.1):
    """Distinct keys over some days; a few windows begin off the quarter hours."""
    rnd, out = random.Random(seed), {}
    for _ in range(n):
        ws = T0 + dt.timedelta(minutes=15 * rnd.randrange(96 * days))
        if rnd.random() < off_grid:
            ws += dt.timedelta(seconds=rnd.randrange(900))
        s, t = rnd.randint(1, 3), rnd.randint(1, 2)
        out[s, t, ws] = (s, t, None if s == 3 and rnd.random() < 0.5 else f"Site {s}", ws, ws + dt.timedelta(minutes=15), 15,
                         20.0, 21.0, rnd.randint(0, 20), 20, None if rnd.random() < 0.1 else rnd.randint(0, 8) / 8)
    return list(out.values())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(cells(1), DDL).cache()


@pytest.fixture(scope="module")
def rollup(spark, rows, tmp_path_factory):
    store = R.rollup_store(spark, str(tmp_path_factory.mktemp("rollup")))
    parts = [rows.where(F.pmod(F.hash("window_start", "sensor_id"), F.lit(3)) == k) for k in range(3)]
    for p in parts:
        store.commit(R.partials(p))
    return store


@pytest.fixture(scope="module")
def coverage(spark, rows, tmp_path_factory):
    store = C.coverage_store(spark, str(tmp_path_factory.mktemp("coverage")))
    for k in range(2):
        store.commit(C.windows_of(rows.where(F.pmod(F.hash("window_start"), F.lit(2)) == k)))
    store.commit(C.windows_of(rows.limit(200)))                 # again: nothing changes
    return store


def same(a, b):
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()] and a.columns == b.columns


RANGES = [("2026-01-01 00:00:00", "2026-01-03 23:59:59"), ("2026-01-01 00:00:00", "2026-01-05 23:59:59"),
          ("2026-01-01 05:20:10", "2026-01-04 18:00:00"), ("2026-01-02 03:10:00", "2026-01-02 03:40:00"),
          ("2025-12-01 00:00:00", "2026-02-10 11:11:11"), ("2026-01-02 06:00:00.5", "2026-01-03 05:59:59.9"),
          ("2030-01-01 00:00:00", "2030-01-02 00:00:00")]


@pytest.mark.parametrize("lo,hi", RANGES)
@pytest.mark.parametrize("width", [None, "6 hours"])
def test_rollup_equals_the_batch_query(rows, rollup, lo, hi, width):
    same(R.connectivity_from_rollup(rollup, lo, hi, bin_width=width, measurements=rows),
         connectivity_stats(rows, lo, hi, bin_width=width))


def test_rollup_filters(rows, rollup):
    lo, hi = RANGES[2]
    same(R.connectivity_from_rollup(rollup, lo, hi, ["Site 1", "Site 3"], [1, 3], measurements=rows),
         connectivity_stats(rows, lo, hi, ["Site 1", "Site 3"], [1, 3]))


def test_whole_bins_need_no_measurements(rollup):
    out = R.connectivity_from_rollup(rollup, "2026-01-01 00:00:00", "2026-02-20 23:59:59")          # 1 day bins
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "level IN" in plan or "level#" in plan and "d1" in plan
    assert "received_packets" not in plan and out.count() > 0
    with pytest.raises(ValueError):
        R.connectivity_from_rollup(rollup, "2026-01-01 00:00:00", "2026-01-01 10:30:00")


def test_cover_has_every_second_once():
    rnd = random.Random(3)
    for _ in range(200):
        lo = T0 + dt.timedelta(seconds=rnd.randrange(10**6))
        hi = lo + dt.timedelta(seconds=rnd.randrange(-10, 10**rnd.randint(1, 6)))
        width = rnd.choice(list(R.LEVELS.values()))
        pieces, edges = R.cover(lo, hi, width)
        spans = sorted([(a, b) for _, a, b in pieces] + [(a, b + dt.timedelta(seconds=1)) for a, b in edges])
        past = hi + dt.timedelta(seconds=1)
        if lo >= past:
            assert not spans
            continue
        assert spans[0][0] == lo and spans[-1][1] == past and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        hour = dt.timedelta(hours=1)
        for a, b in edges:              # no whole hour lies in them
            assert -(-(a - T0) // hour) * hour + hour > b + dt.timedelta(seconds=1) - T0
        for level, a, b in pieces:
            step, zero = R.STEP[level], dt.datetime(1970, 1, 1)
            assert (a - zero) % step == (b - zero) % step == dt.timedelta(0)


def test_stream_in_three_batches_touches_only_its_days(spark, tmp_path):
    every = spark.createDataFrame(cells(7), DDL).cache()
    day = F.to_date("window_start")
    late = (F.col("sensor_id") == 2) & (day == dt.date(2026, 1, 1))
    drops = [every.where((day <= dt.date(2026, 1, 2)) & ~late), every.where(day > dt.date(2026, 1, 2)), every.where(late)]
    store, inbox, versions = R.rollup_store(spark, str(tmp_path / "store")), str(tmp_path / "rows"), []
    for drop in drops:
        drop.write.mode("append").parquet(inbox)
        maintain(spark.readStream.schema(MEASUREMENT_SCHEMA).parquet(inbox), store, R.partials,
                 str(tmp_path / "ledger")).awaitTermination()
        versions.append(dict(store.manifest()["days"]))
    first, second, third = versions
    assert set(first) == {"2026-01-01", "2026-01-02"} and set(second) - set(first) == {
        "2026-01-03", "2026-01-04", "2026-01-05"}
    assert {d for d in second if second[d] != first.get(d, second[d])} == set()
    assert {d for d in third if third[d] != second[d]} == {"2026-01-01"}
    lo, hi = RANGES[1]
    same(R.connectivity_from_rollup(store, lo, hi), connectivity_stats(every, lo, hi))


# ------------------------------------------------------------------ commits
def _sums(store: DayStore):
    return sorted(tuple(r) for r in store.read().where("level = 'h1'").groupBy("day").agg(F.sum("rows")).collect())


@pytest.mark.parametrize("lost", ["before the manifest", "after the manifest"])
def test_commit_cut_short(spark, tmp_path, monkeypatch, lost):
    every = spark.createDataFrame(cells(9, 200), DDL).cache()
    a, b = every.where("treatment_id = 1"), every.where("treatment_id = 2")
    store = R.rollup_store(spark, str(tmp_path / "s"))
    store.commit(R.partials(a), ("w", 0))
    before = _sums(store)
    with monkeypatch.context() as m:
        m.setattr(DayStore, "_announce" if lost.startswith("before") else "_sweep", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(R.partials(b), ("w", 1))
    if lost.startswith("before"):
        assert _sums(store) == before
    assert bool(store.commit(R.partials(b), ("w", 1))) == lost.startswith("before")
    want = sorted(tuple(r) for r in every.groupBy(F.to_date("window_start")).count().collect())
    assert _sums(store) == want
    assert store.commit(R.partials(b), ("w", 1)) == [] == store.commit(R.partials(a), ("w", 0)) and _sums(store) == want


def test_old_versions_go_one_commit_later(spark, tmp_path):
    store = R.rollup_store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame(cells(9, 30, days=1), DDL)
    for k in range(4):
        store.commit(R.partials(one))
        folder = str(tmp_path / "s" / "data" / "day=2026-01-01")
        assert sorted(f for f in os.listdir(folder)) == [f"version={v}" for v in range(max(1, k), k + 2)]
    assert R.rollup_store(spark, str(tmp_path / "none")).read().count() == 0
    assert store.commit(R.partials(one.limit(0))) == []


# ------------------------------------------------------------------ coverage
@pytest.mark.parametrize("lo,hi", RANGES)
def test_coverage_equals_gap_stats(rows, coverage, lo, hi):
    same(C.gap_stats_from_coverage(coverage, lo, hi), gap_stats(rows, lo, hi))


@pytest.mark.parametrize("lo,hi", RANGES[:4])
def test_missing_windows(rows, coverage, lo, hi):
    def secs(v):
        return dt.datetime.fromisoformat(v)
    inside = [r for r in rows.collect() if secs(lo) <= r.window_start <= secs(hi)]
    have = {(r.sensor_id, r.treatment_id, r.location, r.window_start) for r in inside}
    grid, at = [], T0 - dt.timedelta(days=2)
    while at <= secs(hi):
        if at >= secs(lo):
            grid.append(at)
        at += dt.timedelta(minutes=15)
    want = {(*s, w) for s in {k[:3] for k in have} for w in grid} - have
    got = [tuple(r) for r in C.missing_windows(coverage, lo, hi).collect()]
    assert set(got) == want and len(got) == len(want)


def test_coverage_of_hourly_windows(spark, tmp_path):
    rows = spark.createDataFrame(cells(4), DDL)
    store = C.coverage_store(spark, str(tmp_path / "s"), 60)
    store.commit(C.windows_of(rows, 60))
    lo, hi = RANGES[2]
    same(C.gap_stats_from_coverage(store, lo, hi, 60), gap_stats(rows, lo, hi, 60))
    with pytest.raises(ValueError):
        C.slots_of(7)


def test_no_python_worker(rollup, coverage):
    for df in (R.connectivity_from_rollup(rollup, *RANGES[1]), C.missing_windows(coverage, *RANGES[0]),
               C.gap_stats_from_coverage(coverage, *RANGES[2])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan
