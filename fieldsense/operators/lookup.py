"""Sensor location lookup: one join with the sensor dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.schema import UNKNOWN_LOCATION, sensor_dim

def unique_sensors(dim: DataFrame) -> DataFrame:
    """One row per sensor id: the first configuration entry wins.

    Uses the ``first`` flag of ``sensor_dim`` when present (no shuffle),
    else an aggregate over the dimension.
    """
    if "first" in dim.columns:
        return dim.where(F.col("first")).select(F.col("id").alias("sensor_id"), "name",
                                                F.col("location").alias("sensor_location"))
    return (dim.groupBy("id")
            .agg(F.min_by(F.struct("name", "location"), F.col("pos")).alias("_s"))
            .select(F.col("id").alias("sensor_id"), F.col("_s.name").alias("name"),
                    F.col("_s.location").alias("sensor_location")))


def _place_location(base: DataFrame, loc: Column) -> list:
    cols = list(base.columns)
    at = cols.index("treatment_id") + 1 if "treatment_id" in cols else len(cols)
    return [F.col(c) for c in cols[:at]] + [loc.alias("location")] + [F.col(c) for c in cols[at:]]


def add_location(facts: DataFrame, sensors) -> DataFrame:
    """Set ``location`` from the sensor configuration; a sensor that is not
    configured, or has no location, gets 'Unknown'.

    ``sensors`` is a configuration list of any length or a dimension DataFrame
    with ``id, location`` and optionally the ``first``/``pos`` columns of
    ``sensor_dim``. It is one left join that Spark sizes: broadcast when the
    dimension's statistics are under ``spark.sql.autoBroadcastJoinThreshold``
    (exact for a list; AQE re-checks run-time sizes), else a shuffle join, where
    AQE splits a hot sensor.
    """
    base = facts.drop("location") if "location" in facts.columns else facts
    dim = sensors if isinstance(sensors, DataFrame) else sensor_dim(facts.sparkSession, sensors)
    lookup = unique_sensors(dim).select("sensor_id", "sensor_location")
    joined = base.join(lookup, on="sensor_id", how="left")
    loc = F.coalesce(F.col("sensor_location"), F.lit(UNKNOWN_LOCATION))
    return joined.select(*_place_location(base, loc))
