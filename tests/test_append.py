"""Appends and compactions cut short at every step, one evaluation, what the key look-up reads."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from fieldsense.plans.queries import latest_status
from fieldsense.schema import MEASUREMENT_SCHEMA
from fieldsense.sources import table as T
from fieldsense.sources.files import folder_names, path_exists

T0 = dt.datetime(2026, 1, 1)
DDL = MEASUREMENT_SCHEMA.simpleString()[7:-1] + ", seq bigint"


def rows_of(spark, cells):
    """Rows from (sensor, treatment, quarter of an hour)."""
    return spark.createDataFrame(
        [(s, t, f"Site {s % 5}", T0 + dt.timedelta(minutes=15 * q), T0 + dt.timedelta(minutes=15 * q + 15), 15, 20.0, 21.0,
          14, 15, 0.5, i) for i, (s, t, q) in enumerate(cells)], DDL)


def stored(spark, path):
    return sorted((r.sensor_id, r.treatment_id, r.window_start) for r in T.read_table(spark, path).collect())


def series(spark, path):
    return sorted(tuple(r) for r in T.read_series(spark, path).collect())


def status(spark, path):
    return [tuple(r) for r in latest_status(T.read_table(spark, path), T.read_series(spark, path)).collect()]


FIRST = [(1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 1, 0)]
SECOND = [(1, 1, 1), (1, 1, 2), (3, 2, 120), (2, 1, 0)]


def whole(spark, path):
    T.append_new(rows_of(spark, FIRST), path, order_by=["seq"])
    T.append_new(rows_of(spark, SECOND), path, order_by=["seq"])
    return stored(spark, path), series(spark, path), status(spark, path)


@pytest.mark.parametrize("step", ["write_rows", "add_series"])
def test_append_cut_short_is_made_good_by_the_next_run(spark, tmp_path, monkeypatch, step):
    want = whole(spark, str(tmp_path / "want"))
    path = str(tmp_path / "t")
    T.append_new(rows_of(spark, FIRST), path, order_by=["seq"])
    before = stored(spark, path), series(spark, path), status(spark, path)
    with monkeypatch.context() as m:
        m.setattr(T, step, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            T.append_new(rows_of(spark, SECOND), path, order_by=["seq"])
    if step == "write_rows":            # nothing is announced that is not stored
        assert (stored(spark, path), series(spark, path), status(spark, path)) == before
    counts = T.append_new(rows_of(spark, SECOND), path, order_by=["seq"])
    assert counts["inserted"] == (2 if step == "write_rows" else 0) and counts["rows"] == 4
    assert (stored(spark, path), series(spark, path), status(spark, path)) == want


def test_stored_side_is_evaluated_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    T.append_new(rows_of(spark, FIRST), path, order_by=["seq"])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        seen.add(1)
        return True

    real = T.read_table
    monkeypatch.setattr(T, "read_table", lambda *a: real(*a).where(counted("control_temp")))
    assert T.append_new(rows_of(spark, SECOND), path, order_by=["seq"]) == {"rows": 4, "inserted": 2, "duplicates": 2}
    assert seen.value == 3              # the three stored rows, once


def test_series_compaction_cut_short(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    want = whole(spark, path)
    with monkeypatch.context() as m:
        m.setattr(T, "_point_to", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            T.compact_series(spark, path)
    assert (stored(spark, path), series(spark, path), status(spark, path)) == want
    with monkeypatch.context() as m:
        m.setattr(T, "delete", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            T.compact_series(spark, path)
    assert (stored(spark, path), series(spark, path), status(spark, path)) == want
    T.append_new(rows_of(spark, [(7, 1, 5)]), path, order_by=["seq"])
    T.compact_series(spark, path)
    assert len(series(spark, path)) == len(want[1]) + 1
    assert folder_names(spark, T.series_path(path)) == ["generation=2"]
    T.compact_series(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("lost", ["copy", "announced", "day gone", "half replaced"])
def test_day_compaction_cut_short(spark, tmp_path, monkeypatch, lost):
    path, day = str(tmp_path / "t"), dt.date(2026, 1, 1)
    want = whole(spark, path)
    with monkeypatch.context() as m:
        if lost == "copy":
            m.setattr(T, "replace_text", lambda *a: 1 / 0)
        elif lost == "half replaced":
            real = T.delete
            m.setattr(T, "delete", lambda s, p: 1 / 0 if p.endswith("_announced") else real(s, p))
        else:
            m.setattr(T, "_replace_days", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            T.compact_dates(spark, path, [day])
    if lost == "day gone":
        shutil.rmtree(f"{path}/window_date={day}")
    assert (stored(spark, path), status(spark, path)) == (want[0], want[2])
    # the next writer finishes what was announced
    T.append_new(rows_of(spark, [(8, 1, 3), (1, 1, 1)]), path, order_by=["seq"])
    assert not path_exists(spark, f"{path}_compaction/_announced")
    assert stored(spark, path) == sorted([*want[0], (8, 1, T0 + dt.timedelta(minutes=45))])
    T.compact_dates(spark, path, [day])
    assert stored(spark, path) == sorted([*want[0], (8, 1, T0 + dt.timedelta(minutes=45))])
    assert len([f for f in os.listdir(f"{path}/window_date={day}") if f.endswith(".parquet")]) == 1


# ------------------------------------------------------------------ what a look-up reads
def plan_nodes(plan):
    """All nodes of an executed plan, through its query stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    elif name.endswith("QueryStageExec"):
        plan = plan.plan()
    out, kids = [plan], plan.children()
    for i in range(kids.size()):
        out += plan_nodes(kids.apply(i))
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        out += plan_nodes(plan)
    return out


def scanned(df, column):
    """Rows that the scans reading ``column`` gave, after running ``df``."""
    query = df._jdf.queryExecution()
    rows = query.executedPlan().executeCollect()
    total = 0
    for node in plan_nodes(query.executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec" and column in node.output().mkString(","):
            total += node.metrics().apply("numOutputRows").value()
    return total, len(rows)


def test_few_sensors_skip_row_groups(spark, tmp_path, monkeypatch):
    """Each row group holds sensors from the whole range, so only Bloom filters tell them apart."""
    rnd, path = random.Random(4), str(tmp_path / "t")
    ids = rnd.sample(range(10**9), 6000)
    monkeypatch.setattr(T, "FILE_SORT", (T.PARTITION_COLUMN, "treatment_id", "window_start"))
    monkeypatch.setitem(T.WRITE_OPTIONS, "parquet.block.size", "20000")
    monkeypatch.setitem(T.WRITE_OPTIONS, "parquet.bloom.filter.expected.ndv#sensor_id", "2000")
    cells = [(s, i, i % 96) for i, s in enumerate(ids)]
    assert T.append_new(rows_of(spark, cells), path, order_by=["seq"])["inserted"] == 6000
    table = T.read_table(spark, path)
    batch = rows_of(spark, [(ids[10], 10, 10), (ids[11], 10, 11), (5, 1, 1)])
    near = T.probe(table, T0, T0 + dt.timedelta(days=1), [T0.date()], sorted([ids[10], ids[11], 5]))
    read, found = scanned(T.stored_rows(batch, near).select("sensor_id", "location"), "location")
    every, same = scanned(T.stored_rows(batch, T.probe(table, T0, T0 + dt.timedelta(days=1), [T0.date()], None))
                          .select("sensor_id", "location"), "location")
    assert found == same == 1 and every == 6000 and read < 3000
    assert T.append_new(batch, path, order_by=["seq"]) == {"rows": 3, "inserted": 2, "duplicates": 1}
    # more sensors than are named: the same rows without the names
    monkeypatch.setattr(T, "PROBE_SENSORS", 2)
    assert T.append_new(batch, path, order_by=["seq"]) == {"rows": 3, "inserted": 0, "duplicates": 3}


def test_large_batch_on_buckets_leaves_the_stored_side_in_place(spark, tmp_path):
    path, name = str(tmp_path / "t"), "fs_bucketed_test"
    T.ensure_table(spark, path, name, buckets=4)
    rnd = random.Random(5)
    cells = [(rnd.randrange(50), rnd.randrange(3), rnd.randrange(300)) for _ in range(1500)]
    first, second = cells[:900], cells[600:]
    n = T.append_new(rows_of(spark, first), path, order_by=["seq"], table_name=name)["inserted"]
    assert n == len(set(first))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = T.stored_rows(rows_of(spark, second), spark.table(name))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        stored_side = plan[plan.index("SortMergeJoin"):].split("Scan parquet")[0]
        assert "Exchange" not in stored_side and "Bucketed: true" in df._jdf.queryExecution().explainString(
            df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = T.append_new(rows_of(spark, second), path, order_by=["seq"], table_name=name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert got["inserted"] == len(set(cells)) - n and len(stored(spark, path)) == len(set(cells))
    assert spark.table(name).count() == len(set(cells))
