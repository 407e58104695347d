"""Running silence alerts: a sensor that sends nothing for the threshold raises
one alert, as soon as the watermark proves it.

A (sensor, location) keeps its points and one event-time timer, at its earliest point
plus the threshold. When the watermark passes the timer no row up to it can come any
more: a point is followed by a silence if no other lies within the threshold behind
it. Points that are decided go, the timer moves on to the earliest one left. State
(RocksDB) holds the points of one threshold and the watermark's delay only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming import StreamingQuery

from fieldsense.functions.time import epoch_seconds_ntz, ntz_from_seconds
from fieldsense.schema import DEFAULT_GAP_THRESHOLD_HOURS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SilenceProcessor(StatefulProcessor):
    def __init__(self, threshold_s: int):
        self.threshold = threshold_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("points", "points array<bigint>, armed bigint")

    def _keep(self, points: list[int], armed: int | None) -> None:
        """Store the points (seconds, ascending) and set the timer for the first."""
        due = points[0] + self.threshold if points else None
        if due != armed:
            if armed is not None:
                self.handle.deleteTimer(1000 * armed)
            if due is not None:
                self.handle.registerTimer(1000 * due)
        if points:
            self.kept.update((points, due))
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        points, armed = self.kept.get() if self.kept.exists() else ([], None)
        self._keep(sorted({*points, *(r["point_s"] for r in rows)}), armed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        points, armed = self.kept.get()
        points, passed = list(points), timerValues.getCurrentWatermarkInMs() // 1000
        decided = sum(p + self.threshold <= passed for p in points)
        out = [Row(sensor_id=key[0], location=key[1], since_s=p, alert_s=p + self.threshold)
               for p, following in zip(points[:decided], [*points[1:], None])
               if following is None or following >= p + self.threshold]
        self._keep(points[decided:], None)             # the timer that brought us here is spent
        return iter(out)

    def close(self) -> None:
        pass


def silence_alerts(rows: DataFrame, threshold_hours: float = DEFAULT_GAP_THRESHOLD_HOURS,
                   delay: str = "0 seconds") -> DataFrame:
    """``sensor_id, location, last_seen, alert_at`` from a stream of measurement
    rows (append mode): one row per silence of ``threshold_hours`` or more,
    ``alert_at`` being ``last_seen`` plus the threshold.

    ``delay`` is how late rows may come; later ones are not seen. Several rows at one
    time (one per treatment) are one point. Rows without sensor or time give no
    alert, a NULL location is a location of its own. Needs the RocksDB state
    store (``start_alerts`` sets it).
    """
    threshold = int(threshold_hours * 3600)
    timed = (rows.where("sensor_id IS NOT NULL AND window_start IS NOT NULL")
             .select("sensor_id", "location", epoch_seconds_ntz(F.col("window_start")).alias("point_s"))
             .withColumn("event_time", F.timestamp_seconds("point_s"))
             .withWatermark("event_time", delay))
    alerts = timed.groupBy("sensor_id", "location").transformWithState(
        statefulProcessor=SilenceProcessor(threshold),
        outputStructType="sensor_id bigint, location string, since_s bigint, alert_s bigint",
        outputMode="Append", timeMode="EventTime")
    return alerts.select("sensor_id", "location", ntz_from_seconds(F.col("since_s")).alias("last_seen"),
                         ntz_from_seconds(F.col("alert_s")).alias("alert_at"))


def start_alerts(rows: DataFrame, path: str, checkpoint_location: str,
                 threshold_hours: float = DEFAULT_GAP_THRESHOLD_HOURS, delay: str = "0 seconds",
                 once: bool = True, interval_seconds: int = 60) -> StreamingQuery:
    """Append the running alerts to the Parquet folder ``path``."""
    spark = rows.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)                 # read when the query starts
    try:
        w = (silence_alerts(rows, threshold_hours, delay).writeStream.outputMode("append").format("parquet")
             .option("path", path).option("checkpointLocation", checkpoint_location))
        w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{int(interval_seconds)} seconds")
        return w.start()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
