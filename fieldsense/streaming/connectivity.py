"""Connectivity statistics over a stream of measurement rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldsense.functions.time import connectivity_bin, epoch_seconds_ntz, ntz_from_seconds
from fieldsense.operators.filters import in_range, with_filters
from fieldsense.plans.queries import connectivity_rows
from fieldsense.sources.daystore import DayStore


def stream_connectivity(rows: DataFrame, start, end, locations=None, sensor_ids=None,
                        bin_width: str | None = None, watermark: str | None = None) -> DataFrame:
    """The connectivity aggregation on a streaming DataFrame of measurement
    rows (for example ``readStream`` of the measurements table).

    Without ``watermark``: run it in ``complete`` or ``update`` output mode;
    the state is one row per (bin, sensor, location), bounded by the range
    and the bin width. With ``watermark`` (for example ``"2 hours"``): an
    event-time window on the UTC instant of ``window_start``, for ``append``
    output mode; a bin is emitted once the watermark passes its end and its
    state is dropped, so late rows older than the watermark are ignored.
    """
    if watermark is None:
        return connectivity_rows(rows, start, end, locations, sensor_ids, bin_width)
    width = bin_width or connectivity_bin(start, end)
    sel = with_filters(in_range(rows, start, end), locations, sensor_ids)
    timed = (sel.withColumn("_event_time", F.timestamp_seconds(epoch_seconds_ntz(F.col("window_start"))))
             .withWatermark("_event_time", watermark))
    agg = (timed.groupBy(F.window("_event_time", width).alias("_bin"), "sensor_id", "location")
           .agg(F.sum("received_packets").alias("received_count"),
                F.sum("expected_packets").alias("expected_count"),
                F.avg("connection_quality").alias("avg_quality")))
    return agg.select(
        ntz_from_seconds(F.unix_seconds(F.col("_bin.start"))).alias("time_bin"),
        "sensor_id", "location", "received_count", "expected_count", "avg_quality",
        F.least(F.col("received_count") / F.greatest(F.col("expected_count"), F.lit(1)), F.lit(1.0))
        .alias("ratio"))


def start_parquet_sink(agg: DataFrame, path: str, checkpoint_location: str,
                       once: bool = True, output_mode: str = "complete") -> StreamingQuery:
    """Run ``agg`` into the Parquet folder ``path``: closed bins are appended
    (``append``, with a watermark), or every batch replaces the whole result
    (``complete``). Executors write; nothing is gathered in the driver."""
    if output_mode == "append":
        w = agg.writeStream.outputMode("append").format("parquet").option("path", path)
    else:
        def replace(batch: DataFrame, epoch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        w = agg.writeStream.outputMode(output_mode).foreachBatch(replace)
    w = w.option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if once else w
    return w.start()


def maintain(rows: DataFrame, store: DayStore, partials: Callable[[DataFrame], DataFrame], checkpoint_location: str,
             once: bool = True, interval_seconds: int = 60) -> StreamingQuery:
    """Keep a day store (rollup, coverage) up to date with a stream of
    measurement rows.

    Every micro-batch becomes partials that are merged into the days it has rows
    of; other days are not touched, and there is no streaming state, so late rows
    of any age count. A batch that runs again after a failure is recognised by its
    number and left out if it was committed.
    """
    writer = hashlib.md5(checkpoint_location.encode()).hexdigest()[:12]

    def run(batch: DataFrame, epoch_id: int) -> None:
        store.commit(partials(batch), (writer, epoch_id))

    w = rows.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{int(interval_seconds)} seconds")
    return w.start()
