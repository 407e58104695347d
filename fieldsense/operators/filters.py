"""Range and list filters, paging."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.functions.time import to_datetime, ts_lit
from fieldsense.schema import PAGE_SIZE, PARTITION_COLUMN


def in_range(df: DataFrame, start, end, column: str = "window_start") -> DataFrame:
    """``start <= column <= end`` (both inclusive, typed timestamps).

    On the stored table (partitioned by ``window_date``) the matching date
    predicate is added too, because a predicate on the timestamp alone does
    not prune partitions; both are constants and reach the Parquet scan.
    """
    lo, hi = to_datetime(start), to_datetime(end)
    out = df.where(F.col(column).between(ts_lit(lo), ts_lit(hi)))
    if column == "window_start" and PARTITION_COLUMN in df.columns:
        out = out.where(F.col(PARTITION_COLUMN).between(F.lit(lo.date()), F.lit(hi.date())))
    return out


def with_filters(df: DataFrame, locations: Sequence[str] | None = None,
                 sensor_ids: Sequence[int] | None = None,
                 treatment_ids: Sequence[int] | None = None,
                 min_quality: float | None = None) -> DataFrame:
    """Optional IN-lists (None or empty = no filter) and minimum quality
    (inclusive; 0.0 is a real filter, None is none)."""
    if locations:
        df = df.where(F.col("location").isin(list(locations)))
    if sensor_ids:
        df = df.where(F.col("sensor_id").isin([int(s) for s in sensor_ids]))
    if treatment_ids:
        df = df.where(F.col("treatment_id").isin([int(t) for t in treatment_ids]))
    if min_quality is not None:
        df = df.where(F.col("connection_quality") >= F.lit(float(min_quality)))
    return df


def page(df: DataFrame, order_by: Sequence[str], page_no: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows ``size*page_no .. size*page_no+size-1`` in ``order_by`` order.

    Spark plans this as a top-k (TakeOrderedAndProject): every task keeps
    only its best ``offset+size`` rows, nothing else reaches the driver.
    """
    return df.orderBy(*order_by).offset(size * page_no).limit(size)


def _value(v) -> Column:
    return ts_lit(v) if isinstance(v, _dt.datetime) else F.lit(v)


def seek(order_by: Sequence[str], after: Mapping[str, object]) -> Column:
    """Rows that come after the row ``after`` in ascending ``order_by`` order
    (NULL first, as ``orderBy`` does). The first column's bound stands by itself
    as well, so that it reaches the scan."""
    equal: list[Column] = []
    ways: list[Column] = []
    for c in order_by:
        v = after[c]
        beyond = F.col(c).isNotNull() if v is None else F.col(c) > _value(v)
        ways.append(reduce(lambda a, b: a & b, [*equal, beyond]))
        equal.append(F.col(c).isNull() if v is None else F.col(c) == _value(v))
    found = reduce(lambda a, b: a | b, ways)
    first = after[order_by[0]]
    return found if first is None else (F.col(order_by[0]) >= _value(first)) & found


def page_after(df: DataFrame, order_by: Sequence[str], after: Mapping[str, object] | None = None,
               size: int = PAGE_SIZE) -> DataFrame:
    """The next ``size`` rows after the row ``after`` (the last one of the page
    before; None: the first page).

    ``order_by`` must tell all rows apart. A page costs the same wherever it lies:
    the predicate takes the place of an offset, reaches the Parquet scan and, on the
    stored table ordered by ``window_start``, prunes the days before.
    """
    if after is not None:
        df = df.where(seek(order_by, after))
        first = after[order_by[0]]
        if order_by[0] == "window_start" and first is not None and PARTITION_COLUMN in df.columns:
            df = df.where(F.col(PARTITION_COLUMN) >= F.lit(to_datetime(first).date()))
    return df.orderBy(*order_by).limit(size)
