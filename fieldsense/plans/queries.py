"""The analytic queries over the measurements table.

Every function takes the measurements DataFrame (stored table or any frame
with its columns) and returns a lazy DataFrame. Ranges and "now" are
arguments; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.functions.labels import round_like_python, treatment_label
from fieldsense.functions.time import (connectivity_bin, expected_windows, micros_between,
                                       time_floor, to_datetime, ts_lit, whole_second)
from fieldsense.operators.dedup import surrogate_id
from fieldsense.operators.filters import in_range, with_filters
from fieldsense.schema import (DEFAULT_FREQUENCY_MINUTES, DEFAULT_GAP_THRESHOLD_HOURS, DISPLAY_TIME_FORMAT,
                               GAP_LABEL_FORMAT, PARTITION_COLUMN,
                               SILENCE_LOOKBACK_HOURS, SILENT_DEFAULT_LOCATION,
                               SILENT_SENSOR_GAP_HOURS)

LATEST_COLUMNS = ("location", "treatment_id", "sensor_id", "window_start", "window_end",
                  "control_temp", "treatment_temp", "received_packets", "expected_packets",
                  "connection_quality")


# --------------------------------------------------------------------- F5
def fetch_measurements(m: DataFrame, start, end, locations=None, sensor_ids=None,
                       treatment_ids=None, min_quality=None) -> DataFrame:
    """Range fetch: inclusive range, optional IN-lists and minimum quality,
    ordered by window_start; 12 columns with the stable row ``id``."""
    rows = with_filters(in_range(m, start, end), locations, sensor_ids, treatment_ids, min_quality)
    return (rows.select(surrogate_id().alias("id"), "sensor_id", "treatment_id", "location",
                        "window_start", "window_end", "n_observations", "control_temp",
                        "treatment_temp", "received_packets", "expected_packets",
                        "connection_quality")
            .orderBy("window_start"))


# --------------------------------------------------------------------- Q2
def latest_status(m: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """All rows at the latest window_start per (location, treatment_id).

    Ties between sensors of one location are kept (``rank``, not
    ``row_number``). Two plans, by input:

    * the stored table (partitioned by ``window_date``): the latest window of
      every group comes from ``series`` (the series catalog, one row per series
      and batch) or, without it, from a partial ``max`` over three columns of
      the table; the full rows are then fetched only from the date partitions
      that hold a group's latest window (the dates come from a scalar subquery,
      so the scan is pruned at run time) and joined back on (location,
      treatment_id, window_start). The subquery and the join share one
      aggregate.
    * any other frame: ``rank() = 1``, planned as a WindowGroupLimit before
      the shuffle as well, so each map task forwards only its own latest
      rows per group however large a group is.
    """
    keys = ["location", "treatment_id"]
    if PARTITION_COLUMN in m.columns:
        source = m if series is None else series.withColumnRenamed("last_window", "window_start")
        # the join's own NULL filters stand here already, so that Spark sees one aggregate, used twice
        known = source.where(F.col("location").isNotNull() & F.col("treatment_id").isNotNull()
                             & F.col("window_start").isNotNull())
        latest = (known.groupBy(*keys).agg(F.max("window_start").alias("_latest"))
                  .where(F.col("_latest").isNotNull()))
        dates = latest.select(F.collect_set(F.to_date("_latest"))).scalar()
        recent = m.where(F.array_contains(dates, F.col(PARTITION_COLUMN))).select(*LATEST_COLUMNS)
        out = recent.join(latest, on=keys).where(F.col("window_start") == F.col("_latest"))
        return out.select(*LATEST_COLUMNS).orderBy("location", "treatment_id", "sensor_id")
    w = Window.partitionBy(*keys).orderBy(F.col("window_start").desc())
    return (m.select(*LATEST_COLUMNS)
            .withColumn("_rk", F.rank().over(w))
            .where(F.col("_rk") == 1)
            .drop("_rk")
            .orderBy("location", "treatment_id", "sensor_id"))


def latest_status_display(m: DataFrame) -> DataFrame:
    """Latest status as shown: times as text, temperatures to 2 and quality to
    3 digits (``rint(x * 10^d) / 10^d``, the rounding of a pandas column),
    plus the treatment label."""
    fmt = DISPLAY_TIME_FORMAT

    def rounded(c: str, digits: int):
        return (F.rint(F.col(c) * 10 ** digits) / 10 ** digits).alias(c)

    return latest_status(m).select(
        "location", "treatment_id", "sensor_id",
        F.date_format("window_start", fmt).alias("window_start"),
        F.date_format("window_end", fmt).alias("window_end"),
        rounded("control_temp", 2), rounded("treatment_temp", 2),
        "received_packets", "expected_packets",
        rounded("connection_quality", 3),
        treatment_label(F.col("treatment_id")).alias("treatment_label"),
    )


# --------------------------------------------------------------------- Q3
def gap_stats(m: DataFrame, start, end,
              freq: int | _dt.timedelta = DEFAULT_FREQUENCY_MINUTES) -> DataFrame:
    """Missing windows per (sensor, treatment, location) in the range;
    ``freq`` is in minutes or any duration.

    expected = trunc((end - start) / freq) + 1, actual = rows,
    missing = max(expected - actual, 0); groups without rows do not appear.
    """
    expected = expected_windows(start, end, freq)
    return (in_range(m, start, end)
            .groupBy("sensor_id", "treatment_id", "location")
            .agg(F.count(F.lit(1)).alias("actual_count"))
            .select("sensor_id", "treatment_id", "location", "actual_count",
                    F.lit(expected).cast("bigint").alias("expected_count"),
                    F.greatest(F.lit(expected).cast("bigint") - F.col("actual_count"), F.lit(0).cast("bigint"))
                    .alias("missing_count"))
            .orderBy("sensor_id", "treatment_id", "location"))


def gaps_only(gaps: DataFrame) -> DataFrame:
    """Groups with at least one missing window, labelled ``S<sensor>/T<treatment>``."""
    return (gaps.where(F.col("missing_count") > 0)
            .select(F.format_string(GAP_LABEL_FORMAT, F.col("sensor_id").cast("string"),
                                    F.col("treatment_id").cast("string")).alias("label"),
                    "sensor_id", "treatment_id", "missing_count")
            .orderBy("sensor_id", "treatment_id"))


# --------------------------------------------------------------------- Q9
def connectivity_rows(m: DataFrame, start, end, locations=None, sensor_ids=None,
                      bin_width: str | None = None) -> DataFrame:
    """Unordered connectivity aggregate (also valid on a streaming DataFrame)."""
    width = bin_width or connectivity_bin(start, end)
    rows = with_filters(in_range(m, start, end), locations, sensor_ids)
    return (rows.groupBy(time_floor(F.col("window_start"), width).alias("time_bin"),
                         "sensor_id", "location")
            .agg(F.sum("received_packets").alias("received_count"),
                 F.sum("expected_packets").alias("expected_count"),
                 F.avg("connection_quality").alias("avg_quality"))
            .withColumn("ratio", F.least(F.col("received_count") /
                                         F.greatest(F.col("expected_count"), F.lit(1)), F.lit(1.0))))


def connectivity_stats(m: DataFrame, start, end, locations=None, sensor_ids=None,
                       bin_width: str | None = None) -> DataFrame:
    """Packet delivery per (time bin, sensor, location).

    The bin is 1 h for ranges up to 3 days, 6 h up to 30 days, else 1 day
    (chosen from the arguments). ratio = received / max(expected, 1), at most
    1.0. Partial aggregation before the shuffle; output is bins x sensors.
    """
    return (connectivity_rows(m, start, end, locations, sensor_ids, bin_width)
            .orderBy("time_bin", "sensor_id", "location"))


# --------------------------------------------------------------------- Q10
def _lookback(now, hours: int = SILENCE_LOOKBACK_HOURS):
    """The range of the look-back, cut to whole seconds (rows at its edges count)."""
    now = to_datetime(now)
    return whole_second(now - _dt.timedelta(hours=hours)), whole_second(now)


def max_gap(m: DataFrame, now, hours: int = SILENCE_LOOKBACK_HOURS) -> DataFrame:
    """Largest silence per (sensor, location) within ``[now - hours, now]``,
    counting the exact range start and ``now`` as points; ``max_gap_us`` is the
    exact gap in microseconds, ``max_gap_s`` its whole seconds.

    Duplicated window starts (one per treatment) are first reduced to
    distinct points; that shuffle is on (sensor, location, time), so a hot
    sensor is spread over many tasks. Stored window times are whole seconds
    (ingest truncates them), so a group then holds at most
    ``hours * 3600 + 1`` points and the ``lag`` window over it is bounded
    however many rows a sensor sends.
    """
    return _max_gap(m, now, hours).select("sensor_id", "location", "last_seen",
                                          F.expr("max_gap_us div 1000000").alias("max_gap_s"))


def _max_gap(m: DataFrame, now, hours: int) -> DataFrame:
    lo, hi = _lookback(now, hours)
    exact = to_datetime(now)
    begin = ts_lit(exact - _dt.timedelta(hours=hours))
    points = (in_range(m, lo, hi).select("sensor_id", "location", "window_start").distinct())
    w = Window.partitionBy("sensor_id", "location").orderBy("window_start")
    prev = F.lag("window_start", 1, None).over(w)
    steps = points.withColumn("_gap", micros_between(F.coalesce(prev, begin), F.col("window_start")))
    return (steps.groupBy("sensor_id", "location")
            .agg(F.max("_gap").alias("_inner"), F.max("window_start").alias("last_seen"))
            .select("sensor_id", "location", "last_seen",
                    F.greatest(F.col("_inner"), micros_between(F.col("last_seen"), ts_lit(exact)))
                    .alias("max_gap_us")))


def _not_seen(seen_ids: DataFrame, sensors: DataFrame) -> DataFrame:
    """Configuration entries whose id is not in ``seen_ids``.

    One anti join; Spark broadcasts the seen ids when their size (known at
    run time under AQE) is under the broadcast threshold, else it shuffles
    both sides. The seen ids are one per active (sensor, location) pair.
    """
    cfg = sensors.select(F.col("id").alias("sensor_id"), "location", "pos")
    return (cfg.join(seen_ids, "sensor_id", "left_anti")
            .select("sensor_id",
                    F.coalesce(F.col("location"), F.lit(SILENT_DEFAULT_LOCATION)).alias("location"),
                    "pos"))


def silent_sensors(m: DataFrame, sensors: DataFrame, now,
                   hours: int = SILENCE_LOOKBACK_HOURS) -> DataFrame:
    """Configured sensors without any row in ``[now - hours, now]`` (by id).

    Every configuration entry is reported (like the original loop); location
    defaults to lower-case 'unknown'.
    """
    lo, hi = _lookback(now, hours)
    # distinct ids first: the anti join sees one row per sensor, however many rows a sensor sends
    return _not_seen(in_range(m, lo, hi).select("sensor_id").distinct(), sensors)


def gap_rows(m: DataFrame, sensors: DataFrame, now,
             threshold_hours: float = DEFAULT_GAP_THRESHOLD_HOURS,
             hours: int = SILENCE_LOOKBACK_HOURS) -> DataFrame:
    """Alerts, unordered: groups whose largest gap is >= threshold, then silent
    configured sensors at 24 h. ``max_gap_hours`` is rounded to one digit
    like Python's ``round``; the threshold test uses the exact value. The alert order is
    ``kind, pos, sensor_id, location``: gap groups by sensor and location,
    then silent sensors in configuration order. The per-group gaps are computed once and feed
    both the threshold test and the seen-sensor set.
    """
    # both branches read identical group rows (same filters and aggregate
    # outputs), so Spark computes the groups once and reuses the exchange
    groups = _max_gap(m, now, hours).where(F.col("sensor_id").isNotNull())
    gaps = (groups.where(F.col("max_gap_us") >= F.lit(threshold_hours * 3600.0 * 1e6))
            .select("sensor_id", "location", "max_gap_us",
                    F.lit(0).alias("kind"), F.lit(None).cast("int").alias("pos")))
    seen = groups.where(F.col("max_gap_us").isNotNull()).select("sensor_id")
    silent = (_not_seen(seen, sensors)
              .select("sensor_id", "location",
                      F.lit(int(SILENT_SENSOR_GAP_HOURS * 3600) * 1000000).cast("bigint").alias("max_gap_us"),
                      F.lit(1).alias("kind"), "pos"))
    return (gaps.unionByName(silent)
            .select("sensor_id", "location", F.expr("max_gap_us div 1000000").alias("max_gap_s"),
                    round_like_python(F.col("max_gap_us") / 1000000.0 / 3600.0, 1).alias("max_gap_hours"),
                    "kind", "pos"))


def sensor_gaps(m: DataFrame, sensors: DataFrame, now,
                threshold_hours: float = DEFAULT_GAP_THRESHOLD_HOURS,
                hours: int = SILENCE_LOOKBACK_HOURS) -> DataFrame:
    """``gap_rows`` in alert order."""
    return gap_rows(m, sensors, now, threshold_hours, hours).orderBy("kind", "pos", "sensor_id", "location")


# --------------------------------------------------------------------- facets
def distinct_locations(m: DataFrame) -> DataFrame:
    return m.select("location").distinct().orderBy("location")


def distinct_sensors(m: DataFrame) -> DataFrame:
    return m.select("sensor_id").distinct().orderBy("sensor_id")


def distinct_treatments(m: DataFrame) -> DataFrame:
    return m.select("treatment_id").distinct().orderBy("treatment_id")


def sensors_by_location(m: DataFrame, locations: Sequence[str] | None = None) -> DataFrame:
    """Sensors seen at the given locations (all sensors when none given)."""
    return distinct_sensors(with_filters(m, locations=locations))


def treatments_by(m: DataFrame, locations: Sequence[str] | None = None,
                  sensor_ids: Sequence[int] | None = None) -> DataFrame:
    """Treatments seen for the given locations and/or sensors."""
    return distinct_treatments(with_filters(m, locations=locations, sensor_ids=sensor_ids))
