"""Insert-if-absent on the logical key (sensor_id, treatment_id, window_start).

``dedup_first`` keeps the first row per key in a given order: ``row_number``
limited to 1, which Spark also applies inside every map task before the
shuffle (WindowGroupLimit), so a key that holds a large share of the rows
never lands whole in one reduce task. ``insert_if_absent`` first finds which
keys of the batch are stored already (a semi join from the stored side, whose
other side is the small batch) and then removes those from the batch.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.schema import DISPLAY_TIME_FORMAT, KEY, PARTITION_COLUMN


def dedup_first(df: DataFrame, order_by: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """First row per ``key`` in ``order_by`` order (ties: any one of them).

    Output keeps the input column order.
    """
    w = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def surrogate_id(key: Sequence[str] = KEY) -> Column:
    """Stable row id from the key: md5 of ``sensor|treatment|yyyy-MM-dd HH:mm:ss``.

    The same value for the same key in every run (the original's
    auto-increment ids were not consecutive either).
    """
    parts = [F.date_format(F.col(c), DISPLAY_TIME_FORMAT) if c == "window_start" else F.col(c).cast("string")
             for c in key]
    return F.md5(F.concat_ws("|", *parts))


def with_window_date(df: DataFrame) -> DataFrame:
    """Add the storage partition column (UTC date of ``window_start``)."""
    if PARTITION_COLUMN in df.columns:
        return df
    return df.withColumn(PARTITION_COLUMN, F.to_date("window_start"))


def stored_rows(batch: DataFrame, existing: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows of ``existing`` whose key ``batch`` holds.

    A left semi join from the stored side to the batch's distinct keys, on the key
    columns alone. Only the batch side can be broadcast or used as a run-time
    filter, and Spark does so behind its own size check; with a small batch the
    stored side is then scanned in place, never shuffled. A table laid out in
    buckets of the key is not shuffled for a large batch either.
    """
    keys = batch.select(*key).distinct()
    return existing.join(keys, on=list(key), how="left_semi")


def stored_keys(batch: DataFrame, existing: DataFrame, key: Sequence[str] = KEY,
                dates: Sequence[_dt.date] | None = None) -> DataFrame:
    """Keys of ``batch`` that ``existing`` holds. ``dates`` (the exact set of the
    batch's dates) prunes the stored partitions: one late document adds its own
    day, not all days between."""
    stored = existing
    if dates is not None and PARTITION_COLUMN in existing.columns:
        stored = stored.where(F.col(PARTITION_COLUMN).isin(list(dates)))
    return stored_rows(batch, stored.select(*key), key).distinct()


def insert_if_absent(batch: DataFrame, existing: DataFrame, order_by: Sequence[str],
                     key: Sequence[str] = KEY, dates: Sequence[_dt.date] | None = None) -> DataFrame:
    """Rows of ``batch`` that would be inserted: first per key, key not stored
    (columns in the order of ``batch``). ``dates``: see ``stored_keys``."""
    firsts = dedup_first(batch, order_by, key)
    hits = stored_keys(batch, existing, key, dates)
    return firsts.join(hits, on=list(key), how="left_anti").select(*batch.columns)
