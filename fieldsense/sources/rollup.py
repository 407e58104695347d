"""Connectivity rollup: mergeable partial aggregates in bins of one hour, six
hours and one day, kept by day (``DayStore``).

The coarse levels of a day are added up from its hours whenever the day changes.
A query takes every bin from the coarsest level that lies whole in its range;
only the parts of an hour at the two ends of the range need measurement rows.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsense.functions.time import connectivity_bin, time_floor, to_datetime, ts_lit, whole_second
from fieldsense.operators.filters import in_range, with_filters
from fieldsense.sources.daystore import DAY, DayStore

LEVELS = {"h1": "1 hour", "h6": "6 hours", "d1": "1 day"}
STEP = {"h1": _dt.timedelta(hours=1), "h6": _dt.timedelta(hours=6), "d1": _dt.timedelta(days=1)}
KEYS = ("level", DAY, "time_bin", "sensor_id", "location")
SUMS = ("received", "expected", "quality", "quality_rows", "rows")
SCHEMA = T.StructType([
    T.StructField("level", T.StringType()), T.StructField("time_bin", T.TimestampNTZType()),
    T.StructField("sensor_id", T.LongType()), T.StructField("location", T.StringType()),
    T.StructField("received", T.LongType()), T.StructField("expected", T.LongType()),
    T.StructField("quality", T.DoubleType()), T.StructField("quality_rows", T.LongType()),
    T.StructField("rows", T.LongType())])


def partials(rows: DataFrame, level: str = "h1") -> DataFrame:
    """Measurement rows as partials of one level."""
    at = time_floor(F.col("window_start"), LEVELS[level])
    return (rows.groupBy(F.lit(level).alias("level"), F.to_date(at).alias(DAY), at.alias("time_bin"), "sensor_id",
                         "location")
            .agg(F.sum("received_packets").cast("bigint").alias("received"),
                 F.sum("expected_packets").cast("bigint").alias("expected"),
                 F.sum("connection_quality").alias("quality"), F.count("connection_quality").alias("quality_rows"),
                 F.count(F.lit(1)).alias("rows")))


def _added(rows: DataFrame, level: str) -> DataFrame:
    at = time_floor(F.col("time_bin"), LEVELS[level])
    return (rows.groupBy(F.lit(level).alias("level"), DAY, at.alias("time_bin"), "sensor_id", "location")
            .agg(*[F.sum(c).alias(c) for c in SUMS]))


def merged_levels(rows: DataFrame) -> DataFrame:
    """All levels from hourly partials of any number of commits; bins of every
    level lie in one day."""
    hours = _added(rows.where("level = 'h1'"), "h1")
    six = _added(hours, "h6")
    return reduce(DataFrame.unionByName, [hours, six, _added(six, "d1")])


def rollup_store(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, SCHEMA, merged_levels)


def cover(start, end, width: str) -> tuple[list[tuple[str, _dt.datetime, _dt.datetime]], list]:
    """The range ``[start, end]`` (whole seconds, both included) cut into
    ``(level, first bin, past the last bin)`` pieces, none coarser than
    ``width``, and the ``(first, last)`` seconds that no whole hour covers."""
    lo, past = to_datetime(start), whole_second(end) + _dt.timedelta(seconds=1)
    if lo.microsecond:                  # stored window starts are whole seconds
        lo = whole_second(lo) + _dt.timedelta(seconds=1)
    pieces, edges = [], []

    def fill(a: _dt.datetime, b: _dt.datetime, levels: list[str]) -> None:
        if a >= b:
            return
        if not levels:
            edges.append((a, b - _dt.timedelta(seconds=1)))
            return
        step, zero = STEP[levels[0]], _dt.datetime(1970, 1, 1)
        first = zero + -((zero - a) // step) * step
        last = zero + ((b - zero) // step) * step
        if first >= last:
            fill(a, b, levels[1:])
            return
        pieces.append((levels[0], first, last))
        fill(a, first, levels[1:])
        fill(last, b, levels[1:])

    names = [n for n in ("d1", "h6", "h1") if STEP[n] <= STEP[next(k for k, w in LEVELS.items() if w == width)]]
    fill(lo, past, names)
    return pieces, edges


def connectivity_from_rollup(store: DayStore, start, end, locations=None, sensor_ids=None,
                             bin_width: str | None = None, measurements: DataFrame | None = None) -> DataFrame:
    """``connectivity_stats`` answered from the rollup; same columns and order.

    The adaptive bin (or ``bin_width``, one of the levels' widths) names the level.
    A range that begins or ends inside a bin takes the finer levels there, and
    inside an hour the rows of ``measurements``, which are needed only then.
    """
    width = bin_width or connectivity_bin(start, end)
    pieces, edges = cover(start, end, width)
    if edges and measurements is None:
        raise ValueError("the range begins or ends inside an hour: measurements are needed there")
    frames = []
    if pieces:
        stored = store.read(min(a for _, a, _ in pieces).date(), max(b for _, _, b in pieces).date())
        inside = reduce(lambda x, y: x | y, [
            (F.col("level") == level) & (F.col("time_bin") >= ts_lit(a)) & (F.col("time_bin") < ts_lit(b))
            for level, a, b in pieces])
        frames.append(with_filters(stored.where(inside), locations, sensor_ids))
    for a, b in edges:
        frames.append(partials(with_filters(in_range(measurements, a, b), locations, sensor_ids)))
    if not frames:
        frames = [store.read(_dt.date.max)]
    rows = reduce(DataFrame.unionByName, [f.select("time_bin", "sensor_id", "location", *SUMS) for f in frames])
    return (rows.groupBy(time_floor(F.col("time_bin"), width).alias("time_bin"), "sensor_id", "location")
            .agg(F.sum("received").alias("received_count"), F.sum("expected").alias("expected_count"),
                 F.sum("quality").alias("_q"), F.sum("quality_rows").alias("_n"))
            .select("time_bin", "sensor_id", "location", "received_count", "expected_count",
                    F.when(F.col("_n") > 0, F.col("_q") / F.col("_n")).alias("avg_quality"),
                    F.least(F.col("received_count") / F.greatest(F.col("expected_count"), F.lit(1)), F.lit(1.0))
                    .alias("ratio"))
            .orderBy("time_bin", "sensor_id", "location"))
