"""Streaming aggregates: complete mode equals batch; append mode with a
watermark emits closed bins only, compared with a brute-force count."""

import datetime as dt

from fieldsense.plans.queries import connectivity_stats
from fieldsense.schema import MEASUREMENT_SCHEMA
from fieldsense.sources.table import TABLE_SCHEMA, append_new, read_table
from fieldsense.streaming.connectivity import start_parquet_sink, stream_connectivity

T0 = dt.datetime(2026, 1, 1)


def _rows(n_hours):
    out = []
    for h in range(n_hours):
        for q in range(4):
            ws = T0 + dt.timedelta(hours=h, minutes=15 * q)
            out.append((1, 1, "A", ws, ws + dt.timedelta(minutes=15), 15, 20.0, 21.0, 14 + q % 2, 15,
                        (h % 4 + 1) / 4.0, h * 10 + q))
    return out


def _table(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, MEASUREMENT_SCHEMA.simpleString()[7:-1] + ", seq bigint")
    path = str(tmp_path / "table")
    append_new(df, path, order_by=["seq"])
    return path


def test_complete_mode_equals_batch(spark, tmp_path):
    path = _table(spark, tmp_path, _rows(30))
    lo, hi = "2026-01-01 00:00:00", "2026-01-02 23:59:59"
    stream = spark.readStream.schema(TABLE_SCHEMA).parquet(path)
    out = str(tmp_path / "bins")
    start_parquet_sink(stream_connectivity(stream, lo, hi), out, str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in connectivity_stats(read_table(spark, path), lo, hi).collect())
    assert got == want and len(got) == 30


def test_append_mode_with_watermark_emits_closed_bins(spark, tmp_path):
    path = _table(spark, tmp_path, _rows(30))          # points up to 05:45 on day 2
    lo, hi = "2026-01-01 00:00:00", "2026-01-02 23:59:59"
    stream = spark.readStream.schema(TABLE_SCHEMA).parquet(path)
    out = str(tmp_path / "bins")
    start_parquet_sink(stream_connectivity(stream, lo, hi, watermark="2 hours"), out,
                       str(tmp_path / "ck"), output_mode="append").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = sorted(tuple(r) for r in connectivity_stats(read_table(spark, path), lo, hi).collect())
    # watermark = last event (day 2, 05:45) - 2 h = 03:45: bins ending by then are final
    mark = T0 + dt.timedelta(hours=29, minutes=45) - dt.timedelta(hours=2)
    closed = [r for r in batch if r[0] + dt.timedelta(hours=1) <= mark]
    assert got == closed and len(closed) == 27
