"""Window coverage: which windows of a day each series has rows for, as bitmaps.

One bit per window of the day (96 for 15 minutes) and series, kept by day
(``DayStore``) and merged with a bitwise OR, so that a repeated commit changes
nothing. Windows that do not begin on the grid are kept one by one beside the
bitmaps. From this come the number of rows in any range and the missing windows
themselves, without reading measurements.
"""

from __future__ import annotations

import datetime as _dt
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsense.functions.time import epoch_seconds_ntz, expected_windows, ntz_from_seconds, to_datetime, ts_lit, whole_second
from fieldsense.schema import DEFAULT_FREQUENCY_MINUTES
from fieldsense.sources.daystore import DAY, DayStore

SERIES = ("sensor_id", "treatment_id", "location")
SCHEMA = T.StructType([
    T.StructField("sensor_id", T.LongType()), T.StructField("treatment_id", T.LongType()),
    T.StructField("location", T.StringType()), T.StructField("off_grid", T.TimestampNTZType()),
    T.StructField("bits", T.BinaryType())])
BITMAP_BYTES = 4096        # what the bitmap aggregates work on


def slots_of(freq: int) -> int:
    """Windows a day; at most as many as a bitmap has bits."""
    if freq <= 0 or 1440 % freq:
        raise ValueError("the frequency divides a day")
    return 1440 // freq


def _kept(bits: Column, slots: int) -> Column:
    return F.substring(bits, 1, -(-slots // 8))


def windows_of(rows: DataFrame, freq: int = DEFAULT_FREQUENCY_MINUTES) -> DataFrame:
    """Measurement rows as coverage partials."""
    secs = epoch_seconds_ntz(F.col("window_start"))
    second = F.pmod(secs, F.lit(86400))
    marked = rows.where(F.col("window_start").isNotNull()).select(
        *[F.col(c) for c in SERIES], F.to_date("window_start").alias(DAY),
        F.when(F.pmod(secs, F.lit(60 * freq)) != 0, F.col("window_start")).alias("off_grid"),
        F.floor(second / F.lit(60 * freq)).cast("bigint").alias("slot"))
    bits = F.bitmap_construct_agg(F.when(F.col("off_grid").isNull(), F.col("slot")))
    return (marked.groupBy(*SERIES, DAY, "off_grid").agg(_kept(bits, slots_of(freq)).alias("bits"))
            .withColumn("bits", F.when(F.col("off_grid").isNull(), F.col("bits"))))


def _merged(freq: int, rows: DataFrame) -> DataFrame:
    whole = F.expr(f"rpad(bits, {BITMAP_BYTES}, x'00')")
    return (rows.withColumn("bits", F.when(F.col("off_grid").isNull(), whole))
            .groupBy(*SERIES, DAY, "off_grid").agg(F.bitmap_or_agg("bits").alias("bits"))
            .withColumn("bits", F.when(F.col("off_grid").isNull(), _kept(F.col("bits"), slots_of(freq)))))


def coverage_store(spark: SparkSession, path: str, freq: int = DEFAULT_FREQUENCY_MINUTES) -> DayStore:
    return DayStore(spark, path, SCHEMA, partial(_merged, freq))


def bit(bits: Column, slot: Column) -> Column:
    """Whether the bit of a slot is set (the first slot is a byte's lowest bit)."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), slot % 8)) % 2 == 1


def _range(start, end) -> tuple[_dt.datetime, _dt.datetime]:
    lo = to_datetime(start)
    return (whole_second(lo) + _dt.timedelta(seconds=bool(lo.microsecond)), whole_second(end))


def _slot_range(day: Column, lo: _dt.datetime, hi: _dt.datetime, freq: int) -> tuple[Column, Column]:
    """First and last slot of ``day`` whose window begins in ``[lo, hi]``."""
    step, zero = 60 * freq, _dt.datetime(1970, 1, 1)
    midnight = F.unix_date(day).cast("bigint") * 86400
    a = F.ceil((F.lit(int((lo - zero).total_seconds())) - midnight) / F.lit(step))
    b = F.floor((F.lit(int((hi - zero).total_seconds())) - midnight) / F.lit(step))
    return F.greatest(a, F.lit(0)).cast("int"), F.least(b, F.lit(slots_of(freq) - 1)).cast("int")


def gap_stats_from_coverage(store: DayStore, start, end, freq: int = DEFAULT_FREQUENCY_MINUTES) -> DataFrame:
    """``gap_stats`` answered from the bitmaps; same columns and order. Days that
    lie whole in the range are counted bit by bit at once, days cut by it slot by slot."""
    lo, hi = _range(start, end)
    stored = store.read(lo.date(), hi.date())
    first, last = _slot_range(F.col(DAY), lo, hi, freq)
    whole = (first == 0) & (last == slots_of(freq) - 1)
    some = F.size(F.filter(F.sequence(first, last), lambda s: bit(F.col("bits"), s)))
    n = (F.when(F.col("off_grid").isNotNull(), F.col("off_grid").between(ts_lit(lo), ts_lit(hi)).cast("bigint"))
         .when(first > last, F.lit(0))
         .when(whole, F.bitmap_count(F.expr(f"rpad(bits, {BITMAP_BYTES}, x'00')")))
         .otherwise(some.cast("bigint")))
    expected = F.lit(expected_windows(start, end, freq)).cast("bigint")
    return (stored.withColumn("n", n).groupBy(*SERIES).agg(F.sum("n").alias("actual_count"))
            .where("actual_count > 0")
            .select(*SERIES, "actual_count", expected.alias("expected_count"),
                    F.greatest(expected - F.col("actual_count"), F.lit(0).cast("bigint")).alias("missing_count"))
            .orderBy(*SERIES))


def missing_windows(store: DayStore, start, end, freq: int = DEFAULT_FREQUENCY_MINUTES) -> DataFrame:
    """``sensor_id, treatment_id, location, window_start``: the windows on the
    grid in the range that a series with rows in it has none for."""
    lo, hi = _range(start, end)
    stored = store.read(lo.date(), hi.date())
    first, last = _slot_range(F.col(DAY), lo, hi, freq)
    days = F.sequence(F.lit(lo.date()), F.lit(hi.date()))
    seen = gap_stats_from_coverage(store, start, end, freq).select(*SERIES)
    every = seen.select(*SERIES, F.explode(days).alias(DAY))
    bits = stored.where("off_grid IS NULL").select(*[F.col(c).alias(f"_{c}") for c in (*SERIES, DAY)], "bits")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*SERIES, DAY)]
    slots = F.when(first <= last, F.filter(
        F.sequence(first, last), lambda s: F.col("bits").isNull() | ~bit(F.col("bits"), s)))
    secs = F.unix_date(DAY).cast("bigint") * 86400 + F.col("slot") * F.lit(60 * freq)
    return (every.join(bits, same, "left").select(*SERIES, DAY, F.explode(slots).alias("slot"))
            .select(*SERIES, ntz_from_seconds(secs).alias("window_start"))
            .orderBy(*SERIES, "window_start"))
