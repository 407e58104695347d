"""Chart data as long-format DataFrames: temperature series, connectivity
bars, filter options and the alert line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.functions.labels import (alert_text, percent_text, quality_color,
                                         sensor_option_label, treatment_label, two_digits)
from fieldsense.operators.filters import with_filters
from fieldsense.schema import ALERT_SEPARATOR, SENSOR_SERIES_FORMAT


def control_rows(m: DataFrame) -> DataFrame:
    """One control value per (sensor, window), unordered: the lowest treatment's.

    An aggregate (``min_by``) instead of a ``row_number`` window, so it is
    combined map-side before the shuffle.
    """
    return (m.groupBy("sensor_id", "window_start")
            .agg(F.min_by("control_temp", "treatment_id").alias("value"))
            .select(F.lit("Control").alias("series"), F.lit(None).cast("bigint").alias("treatment_id"),
                    "sensor_id", "window_start", "value"))


def control_series(m: DataFrame) -> DataFrame:
    """``control_rows`` ordered by sensor and time."""
    return control_rows(m).orderBy("sensor_id", "window_start")


def _treatments(m: DataFrame, treatment_ids: Sequence[int] | None) -> DataFrame:
    return m.where(F.col("treatment_id").isin([int(t) for t in treatment_ids])) if treatment_ids else m


def temperature_series(m: DataFrame, treatment_ids: Sequence[int] | None = None,
                       mode: str = "absolute") -> DataFrame:
    """Long-format series ``series, treatment_id, sensor_id, window_start, value``.

    ``absolute``: the control series plus treatment_temp per treatment;
    ``delta``: treatment_temp - control_temp per treatment. Treatments are
    limited to ``treatment_ids`` when given.
    """
    rows = _treatments(m, treatment_ids)
    if mode == "delta":
        value = F.col("treatment_temp") - F.col("control_temp")
    elif mode == "absolute":
        value = F.col("treatment_temp")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    per_treatment = rows.select(treatment_label(F.col("treatment_id")).alias("series"),
                                "treatment_id", "sensor_id", "window_start", value.alias("value"))
    if mode == "absolute":
        per_treatment = control_rows(m).unionByName(per_treatment)
    return per_treatment.orderBy("series", "sensor_id", "window_start")


def connectivity_series(stats: DataFrame) -> DataFrame:
    """Bars per sensor from ``connectivity_rows``: series name with the sensor's
    first location (in time, then by name), bar colour from the average quality
    and the hover texts. The first locations are one small aggregate, joined on
    the sensor; the order is made once, at the output."""
    names = (stats.groupBy("sensor_id")
             .agg(F.min(F.struct("time_bin", "location")).alias("_first"))
             .select(F.col("sensor_id").alias("_sensor"), F.col("_first.location").alias("_location")))
    return (stats.join(names, F.col("sensor_id") == F.col("_sensor")).select(
        F.format_string(SENSOR_SERIES_FORMAT, F.col("sensor_id").cast("string"), F.col("_location")).alias("series"),
        "sensor_id", "time_bin", "location", "ratio",
        quality_color(F.col("avg_quality")).alias("color"),
        percent_text(F.col("ratio")).alias("ratio_text"),
        two_digits(F.col("avg_quality")).alias("quality_text"),
        F.format_string("%d / %d", F.col("received_count"), F.col("expected_count")).alias("packets_text"))
        .orderBy("sensor_id", "time_bin"))


def filter_options(m: DataFrame, locations: Sequence[str] | None = None,
                   sensor_ids: Sequence[int] | None = None) -> DataFrame:
    """The cascading filter options as ``facet, label, value`` rows, in this
    order: all locations; sensors of the chosen locations; treatments of the
    chosen locations and sensors; each by value.

    One scan finds the series (location, sensor, treatment); the three facets are
    taken from them and sorted once. ``m`` may be the series catalog.
    """
    series = m.select("location", "sensor_id", "treatment_id").distinct()

    def facet(rows, position, name, label, value, number):
        return rows.select(F.lit(position).alias("_facet"), F.lit(name).alias("facet"), label.alias("label"),
                           value.cast("string").alias("value"), number.cast("bigint").alias("_number")).distinct()

    sid, tid, none = F.col("sensor_id"), F.col("treatment_id"), F.lit(None)
    options = (facet(series, 0, "location", F.col("location"), F.col("location"), none)
               .unionByName(facet(with_filters(series, locations), 1, "sensor", sensor_option_label(sid), sid, sid))
               .unionByName(facet(with_filters(series, locations, sensor_ids), 2, "treatment", treatment_label(tid),
                                  tid, tid)))
    return options.orderBy("_facet", "_number", "value").select("facet", "label", "value")


def alert_lines(alerts: DataFrame) -> DataFrame:
    """One row per alert with its text, unordered (no exchange): ``kind, pos,
    sensor_id, location, text``."""
    return alerts.select("kind", "pos", "sensor_id", "location",
                         alert_text(F.col("sensor_id"), F.col("location"), F.col("max_gap_hours")).alias("text"))


def gap_alert_text(alerts: DataFrame) -> DataFrame:
    """One row: the ``alert_lines`` joined with '; ' in alert order (empty text
    and 0 alerts when there is none). A display step: the line is one value, so
    its length is the number of alerts; use ``alert_lines`` where they are many."""
    ordered = F.struct(F.col("kind"), F.col("pos"), F.col("sensor_id"), F.col("location"), F.col("text").alias("t"))
    return alert_lines(alerts).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(ordered)), lambda s: s["t"]), ALERT_SEPARATOR)
        .alias("text"))
