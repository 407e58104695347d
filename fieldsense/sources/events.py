"""Stand-in input built from the driver's ``events`` table.

The test data has no sensor measurements, so ``events`` rows are reshaped
into rows of the measurement input schema (and into JSON documents of the
ingest format). This module only shapes input; all analytic work is done by
the library's operators on the result, which must not rely on how it is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldsense.functions.time import time_floor
from fieldsense.operators.dedup import dedup_first
from fieldsense.operators.lookup import add_location
from fieldsense.schema import sensor_dim

# Sensor configuration used with the driver data: sensors share a location in
# pairs, sensor 8 is not configured, sensor 99 never reports.
FIXTURE_SENSORS = [
    {"id": 1, "name": "Sensor 1", "location": "Site 1"},
    {"id": 2, "name": "Sensor 2", "location": "Site 1"},
    {"id": 3, "name": "Sensor 3", "location": "Site 2"},
    {"id": 4, "name": "Sensor 4", "location": "Site 2"},
    {"id": 5, "name": "Sensor 5", "location": "Site 3"},
    {"id": 6, "name": "Sensor 6", "location": "Site 3"},
    {"id": 7, "name": "Sensor 7", "location": "Site 4"},
    {"id": 99, "name": "Sensor 99", "location": "Site 9"},
]


def fixture_sensors(spark: SparkSession) -> DataFrame:
    return sensor_dim(spark, FIXTURE_SENSORS)


EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table with its known schema (no schema-inference job)."""
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event, without location (added by the lookup)."""
    return readings_from_events(read_events(spark, sf_dir))


def readings_from_events(ev: DataFrame, sensor_per_user: bool = False, width: str = "15 minutes") -> DataFrame:
    """Reshape ``events`` rows (batch or stream) into readings of eight sensors,
    or of one sensor per user (as many as the table has users), in windows that
    begin at multiples of ``width``."""
    k = F.get_json_object("props", "$.k").cast("int")
    tid = F.col("event_id") % 3 + 1
    start = time_floor(F.col("ts"), width)
    sensor = F.col("user_id") if sensor_per_user else F.col("user_id") % 8 + 1
    return ev.select(
        "event_id",
        sensor.cast("bigint").alias("sensor_id"),
        tid.cast("bigint").alias("treatment_id"),
        start.alias("window_start"),
        (start + F.expr("INTERVAL 15 MINUTES")).alias("window_end"),
        F.lit(15).cast("bigint").alias("n_observations"),
        F.col("value").alias("control_temp"),
        (F.col("value") + F.lit(1.5) * tid).alias("treatment_temp"),
        F.when(k >= 90, 20 + k % 3).otherwise(20 - k % 5).cast("bigint").alias("received_packets"),
        F.lit(20).cast("bigint").alias("expected_packets"),
        ((k + 29).cast("double") / 128).alias("connection_quality"),
    )


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with location from the fixture sensor configuration."""
    return add_location(raw_readings(spark, sf_dir), FIXTURE_SENSORS)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-duplicated fact table: first event per key wins; the location is
    looked up for the rows that stay."""
    firsts = dedup_first(raw_readings(spark, sf_dir), order_by=["event_id"]).drop("event_id")
    return add_location(firsts, FIXTURE_SENSORS)


READINGS_PER_DOCUMENT = 3


def user_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large sensor dimension, one sensor per user of ``events`` that has an
    even id; sensors share a location in groups of ten."""
    users = read_events(spark, sf_dir).select(F.col("user_id").alias("id")).where("user_id % 2 = 0").distinct()
    return users.select("id", F.format_string("Sensor %d", "id").alias("name"),
                        F.format_string("Site %d", F.expr("id div 10")).alias("location"), F.lit(0).alias("pos"))


def documents(spark: SparkSession, sf_dir: str, offset: str | None = None,
              bad_quality_above: float | None = None) -> DataFrame:
    """``document_structs`` as text: ``(file_name, value)`` like a whole-text file scan."""
    return document_structs(spark, sf_dir, offset, bad_quality_above).select(
        "file_name", F.to_json("doc").alias("value"))


def document_structs(spark: SparkSession, sf_dir: str, offset: str | None = None,
                     bad_quality_above: float | None = None, width: str = "15 minutes") -> DataFrame:
    """Documents in the ingest file format, each with up to three readings
    of one sensor in one window (as a real document has one per treatment); a
    window with more readings has several documents.

    Returns ``(file_name, doc)``. ``offset``
    (for example ``"+02:00"``) writes the window times as local time with
    that offset; ``bad_quality_above`` writes quality 1.5 into every treatment
    whose control temperature is above the value, so that document must be
    rejected. Treatments keep event order inside a document.
    """
    order = Window.partitionBy("sensor_id", "window_start").orderBy("event_id")
    readings = readings_from_events(read_events(spark, sf_dir), width=width)
    r = (readings.withColumn("_rn", F.row_number().over(order))
         .withColumn("part", F.expr(f"(_rn - 1) div {READINGS_PER_DOCUMENT}")))
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    if offset:
        sign = -1 if offset.startswith("-") else 1
        hh, mm = offset[1:].split(":")
        shift = F.make_dt_interval(F.lit(0), F.lit(sign * int(hh)), F.lit(sign * int(mm)), F.lit(0))
        ws = F.concat(F.date_format(F.col("window_start") + shift, fmt), F.lit(offset))
        we = F.concat(F.date_format(F.col("window_end") + shift, fmt), F.lit(offset))
    else:
        ws, we = F.date_format("window_start", fmt), F.date_format("window_end", fmt)
    q = F.col("connection_quality")
    if bad_quality_above is not None:
        q = F.when(F.col("control_temp") > bad_quality_above, F.lit(1.5)).otherwise(q)
    treatment = F.struct(
        F.col("event_id"),
        F.col("treatment_id"),
        F.col("control_temp").alias("mean_control_temp"),
        F.col("treatment_temp").alias("mean_treatment_temp"),
        F.col("received_packets"),
        F.col("expected_packets"),
        q.alias("connection_quality"),
    )
    grouped = (r.groupBy("sensor_id", "window_start", "part")
               .agg(F.first(ws).alias("ws"), F.first(we).alias("we"),
                    F.first("n_observations").alias("n_obs"),
                    F.array_sort(F.collect_list(treatment)).alias("ts")))
    doc = F.struct(
        F.col("sensor_id").alias("site_id"),
        F.col("ws").alias("window_start"),
        F.col("we").alias("window_end"),
        F.col("n_obs").alias("n_observations"),
        F.transform("ts", lambda t: t.dropFields("event_id")).alias("treatments"),
    )
    name = F.format_string("site%d_%s_%03d.json", F.col("sensor_id"),
                           F.date_format("window_start", "yyyyMMdd'T'HHmmss"), F.col("part"))
    return grouped.select(name.alias("file_name"), doc.alias("doc"))
