"""Keyset pages: joined they are the full order, and a late page reads no more than the first."""

import datetime as dt
import random

import pytest

from fieldsense.operators.filters import page, page_after
from fieldsense.schema import MEASUREMENT_SCHEMA
from fieldsense.sources.table import append_new, read_table
from test_append import scanned

T0 = dt.datetime(2026, 1, 1)


def all_pages(df, order_by, size):
    out, after = [], None
    while True:
        rows = page_after(df, order_by, after, size).collect()
        out.append([tuple(r) for r in rows])
        if len(rows) < size:
            return out
        after = rows[-1].asDict()


@pytest.mark.parametrize("size", [1, 7, 10, 500])
def test_pages_joined_are_the_full_order(spark, size):
    rnd = random.Random(size)
    rows = list({(rnd.choice([None, "a", "b", "ü"]), rnd.choice([None, 1, 2, 3]), i % 9 if i % 5 else None,
                  T0 + dt.timedelta(seconds=i // 3), i) for i in range(40 if size == 1 else 120)})
    df = spark.createDataFrame(rows, "a string, b int, c bigint, t timestamp_ntz, i int").repartition(3)
    for order in (["a", "b", "i"], ["t", "c", "i"], ["c", "i"]):
        want = [tuple(r) for r in df.orderBy(*order).collect()]
        pages = all_pages(df, order, size)
        assert [r for p in pages for r in p] == want
        assert pages[0] == [tuple(r) for r in page(df, order, 0, size).collect()]


def test_a_late_page_reads_no_more_than_the_first(spark, tmp_path):
    path, order = str(tmp_path / "t"), ["window_start", "sensor_id", "treatment_id"]
    rows = [(s, 1, "A", T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1), 15, 1.0, 2.0, 14, 15, 0.5, h * 9 + s)
            for h in range(24 * 20) for s in range(5)]
    append_new(spark.createDataFrame(rows, MEASUREMENT_SCHEMA.simpleString()[7:-1] + ", seq bigint"), path, order_by=["seq"])
    table = read_table(spark, path)
    ordered = [tuple(r) for r in table.orderBy(*order).collect()]
    first, _ = scanned(page_after(table, order), "window_start")
    for n in (60, 120, 230):
        last = dict(zip(table.columns, ordered[10 * n - 1]))
        df = page_after(table, order, last)
        read, got = scanned(df, "window_start")
        assert [tuple(r) for r in df.collect()] == ordered[10 * n:10 * n + 10] and got == 10
        assert read <= first * (1 - n / 240) + 24 * 5 * 2       # only the days from there on
        assert "PartitionFilters: [isnotnull(window_date" in df._jdf.queryExecution().executedPlan().toString()
