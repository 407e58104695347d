"""The measurements table: Parquet partitioned by ``window_date``.

Written only through ``append_new`` (insert-if-absent on the key). One
writer per table at a time (for example one streaming query): two concurrent
writers could both pass the anti join for the same new key.

Every step that replaces something can be cut short at any point: the series
catalog changes by writing a generation aside and moving a pointer, compacted
days are written aside and announced by a pointer before the live ones go.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsense.functions.time import ts_lit
from fieldsense.operators.dedup import dedup_first, stored_rows, with_window_date
from fieldsense.schema import KEY, MEASUREMENT_COLUMNS, MEASUREMENT_SCHEMA, PARTITION_COLUMN
from fieldsense.session import ensure_checkpoint_dir
from fieldsense.sources.files import delete, folder_names, path_exists, read_text, replace_text

TABLE_SCHEMA = T.StructType(list(MEASUREMENT_SCHEMA.fields) +
                            [T.StructField(PARTITION_COLUMN, T.DateType(), True)])
SERIES_SCHEMA = T.StructType([T.StructField("location", T.StringType()), T.StructField("sensor_id", T.LongType()),
                              T.StructField("treatment_id", T.LongType()),
                              T.StructField("last_window", T.TimestampNTZType())])
# row order inside each written file: min/max statistics per row group then
# let location / sensor / time predicates skip row groups
FILE_SORT = (PARTITION_COLUMN, "location", "sensor_id", "treatment_id", "window_start")
# Parquet writes a Bloom filter per row group for the sensors, so a look-up of a
# few sensors skips the row groups that hold none of them
WRITE_OPTIONS = {"parquet.bloom.filter.enabled#sensor_id": "true",
                 "parquet.bloom.filter.expected.ndv#sensor_id": "100000"}
PROBE_SENSORS = 1000       # a batch of at most so many sensors names them to the scan of stored keys


def table_exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path)


def ensure_table(spark: SparkSession, path: str, name: str | None = None, buckets: int | None = None) -> None:
    """Create the (empty) table folder, and a catalog entry when ``name`` is given.

    ``buckets`` (with ``name``) lays the rows out by a hash of the key: a large
    batch then meets the stored keys without the stored side being shuffled.
    """
    if not table_exists(spark, path):
        (spark.createDataFrame([], TABLE_SCHEMA).write.mode("append")
         .partitionBy(PARTITION_COLUMN).parquet(path))
    if name:
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLE_SCHEMA.fields)
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        options = ", ".join(f"'{k}' '{v}'" for k, v in WRITE_OPTIONS.items())
        layout = f"CLUSTERED BY ({', '.join(KEY)}) INTO {int(buckets)} BUCKETS" if buckets else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet OPTIONS ({options}) "
                  f"PARTITIONED BY ({PARTITION_COLUMN}) {layout} LOCATION '{location}'")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows (empty with the table schema when nothing is stored).

    Where a compaction was cut short, the days it was replacing are read from
    their announced copy.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], TABLE_SCHEMA)
    live = spark.read.schema(TABLE_SCHEMA).parquet(path)
    redo = _announced(spark, path)
    if redo is None:
        return live
    dates = [_dt.date.fromisoformat(d) for d in redo["dates"]]
    return (live.where(~F.col(PARTITION_COLUMN).isin(dates))
            .unionByName(spark.read.schema(TABLE_SCHEMA).parquet(redo["rows"])))


# ------------------------------------------------------------------ series catalog
def series_path(path: str) -> str:
    """The series catalog beside a measurements table: one folder per generation
    and a pointer to the one that counts."""
    return path.rstrip("/") + "_series"


def _generation(spark: SparkSession, path: str) -> int:
    return int(read_text(spark, f"{series_path(path)}/_current") or 0)


def _series_folder(path: str, generation: int) -> str:
    return f"{series_path(path)}/generation={generation}"


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The series of the table at ``path``: ``location, sensor_id,
    treatment_id, last_window``, one row each (empty when nothing is stored).

    Every append adds one row per series it touches; the largest window counts,
    so a repeated append changes nothing.
    """
    folder = _series_folder(path, _generation(spark, path))
    if not path_exists(spark, folder):
        return spark.createDataFrame([], SERIES_SCHEMA)
    rows = spark.read.schema(SERIES_SCHEMA).parquet(folder)
    return rows.groupBy("location", "sensor_id", "treatment_id").agg(F.max("last_window").alias("last_window"))


def compact_series(spark: SparkSession, path: str) -> None:
    """Rewrite the series catalog as one row per series, in as few files as its size asks for.

    The new generation is written aside; one rename of the pointer makes it
    count, and only then the old one goes. Cut short before the rename nothing has
    changed, after it only an unused folder is left (the next compaction removes it).
    Run it while no writer is active.
    """
    now = _generation(spark, path)
    if not path_exists(spark, _series_folder(path, now)):
        return
    (read_series(spark, path).hint("rebalance").write.mode("overwrite")
     .parquet(_series_folder(path, now + 1)))
    _point_to(spark, path, now + 1)
    for name in folder_names(spark, series_path(path)):
        if name != f"generation={now + 1}":
            delete(spark, f"{series_path(path)}/{name}")


def _point_to(spark: SparkSession, path: str, generation: int) -> None:
    replace_text(spark, f"{series_path(path)}/_current", str(generation))


# ------------------------------------------------------------------ compaction of days
def _compaction_path(path: str) -> str:
    return path.rstrip("/") + "_compaction"


def _announced(spark: SparkSession, path: str) -> dict | None:
    """The compaction that is under way: ``{"rows": folder, "dates": [...]}``."""
    text = read_text(spark, f"{_compaction_path(path)}/_announced")
    return json.loads(text) if text else None


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Carry out an announced compaction (again, if it was cut short): the days'
    partitions are replaced by the announced copy. Writers call this first."""
    redo = _announced(spark, path)
    if redo is not None:
        _replace_days(spark, path, redo)
        delete(spark, f"{_compaction_path(path)}/_announced")
        delete(spark, redo["rows"])


def _replace_days(spark: SparkSession, path: str, redo: dict) -> None:
    rows = spark.read.schema(TABLE_SCHEMA).parquet(redo["rows"])
    (rows.repartitionByRange(max(1, redo["files"]), *FILE_SORT).sortWithinPartitions(*FILE_SORT)
     .write.mode("overwrite").options(**WRITE_OPTIONS)
     .option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION_COLUMN).parquet(path))


def compact_dates(spark: SparkSession, path: str, dates: Sequence[_dt.date], files_per_date: int = 1) -> None:
    """Rewrite the given days as few files, sorted like an append sorts them.

    Micro-batches add at least one small file per day they touch. The days'
    rows are copied beside the table and announced; then exactly their partitions
    are replaced (dynamic partition overwrite) and the announcement is taken back.
    Cut short in between, readers take the days from the copy and the next
    writer finishes the job. Run it while no writer is active.
    """
    finish_compaction(spark, path)
    aside = f"{_compaction_path(path)}/rows-{uuid.uuid4().hex}"
    days = read_table(spark, path).where(F.col(PARTITION_COLUMN).isin(list(dates)))
    days.write.mode("overwrite").parquet(aside)
    replace_text(spark, f"{_compaction_path(path)}/_announced",
                 json.dumps({"rows": aside, "dates": [d.isoformat() for d in dates],
                             "files": files_per_date * len(dates)}))
    finish_compaction(spark, path)


# ------------------------------------------------------------------------ append
def probe(existing: DataFrame, lo: _dt.datetime, hi: _dt.datetime, dates: Sequence[_dt.date],
          sensors: Sequence[int] | None) -> DataFrame:
    """The stored rows that a batch can meet: its days (partitions), its time
    range and, for few sensors, the sensors by name. All reach the Parquet scan,
    where row-group statistics and Bloom filters skip what cannot match."""
    out = existing.where(F.col(PARTITION_COLUMN).isin(list(dates))
                         & F.col("window_start").between(ts_lit(lo), ts_lit(hi)))
    if sensors is not None:
        # an OR of equalities is checked against Bloom filters; a long IN-list would only give its range
        named = [F.col("sensor_id") == F.lit(s) for s in sensors]
        out = out.where(_any_of(named))
    return out


def _any_of(tests: list):
    """A balanced OR, so that the expression's depth stays small."""
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + ([tests[-1]] if len(tests) % 2 else [])
    return tests[0]


def append_new(rows: DataFrame, path: str, order_by: Sequence[str] = ("file_name", "pos"),
               key: Sequence[str] = KEY, table_name: str | None = None) -> dict:
    """Append the rows whose key is not stored yet; first row per key wins.

    ``rows`` carries the measurement columns plus the ``order_by`` columns. One
    aggregate over the batch gives its row count, dates and time range, which
    with its sensors (named up to ``PROBE_SENSORS``) prune the stored side. What is
    stored of the batch's keys (a semi join whose small side is the batch) and the
    rows that are new are each evaluated once and saved in the shared checkpoint
    folder; an observation counts them on the way.

    The new rows are written first, with a REBALANCE on the partition column (AQE
    splits a hot day, merges small ones), sorted inside each file. Then the series
    catalog gets the latest window of every series the batch holds rows of, new or
    stored before. So a run that fails in between is made good by running the batch
    again: its rows are then stored already, and their series are added. With
    ``table_name`` (a catalog table made by ``ensure_table``) the rows are read and
    appended through the catalog (``insertInto``), which also registers new date
    partitions. Returns ``{"rows", "inserted", "duplicates"}``.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    cols = list(MEASUREMENT_COLUMNS) + [c for c in order_by if c not in MEASUREMENT_COLUMNS]
    batch = with_window_date(rows.select(*cols)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        b = batch.agg(F.count(F.lit(1)).alias("n"), F.collect_set(PARTITION_COLUMN).alias("dates"),
                      F.min("window_start").alias("lo"), F.max("window_start").alias("hi")).first()
        if not b["n"]:
            return {"rows": 0, "inserted": 0, "duplicates": 0}
        finish_compaction(spark, path)
        known = None
        firsts = dedup_first(batch, order_by, key)
        if table_name or table_exists(spark, path):
            existing = spark.table(table_name) if table_name else read_table(spark, path)
            ids = [r[0] for r in batch.select("sensor_id").distinct().limit(PROBE_SENSORS + 1).collect()]
            near = probe(existing, b["lo"], b["hi"], sorted(b["dates"]),
                         sorted(ids) if len(ids) <= PROBE_SENSORS else None)
            known = stored_rows(batch, near, key).select(*key, "location").checkpoint()
            firsts = firsts.join(known.select(*key), on=list(key), how="left_anti")
        counted = Observation()
        new = (firsts.select(*[F.col(f.name).cast(f.dataType) for f in TABLE_SCHEMA.fields])
               .observe(counted, F.count(F.lit(1)).alias("n")).checkpoint())
        inserted = int(counted.get["n"])
        if inserted:
            write_rows(new, path, table_name)
        add_series(spark, path, new if known is None else new.select(*known.columns).unionByName(known))
        return {"rows": int(b["n"]), "inserted": inserted, "duplicates": int(b["n"]) - inserted}
    finally:
        batch.unpersist()


def write_rows(new: DataFrame, path: str, table_name: str | None = None) -> None:
    """Add rows of the table's schema to the table."""
    out = new.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(*FILE_SORT)
    if table_name:
        out.write.insertInto(table_name)
    else:
        out.write.mode("append").options(**WRITE_OPTIONS).partitionBy(PARTITION_COLUMN).parquet(path)


def add_series(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add the series of stored rows to the catalog, with their latest window."""
    touched = rows.groupBy("location", "sensor_id", "treatment_id").agg(F.max("window_start").alias("last_window"))
    folder = _series_folder(path, _generation(spark, path))
    touched.hint("rebalance").write.mode("append").parquet(folder)
