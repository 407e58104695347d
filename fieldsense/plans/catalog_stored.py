"""Registered queries on what is kept beside measurements (rollup, coverage), on
keyset pages, running alerts, free-form dates and interrupted runs, with their
DuckDB SQL. Imported by ``catalog``, whose helpers they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldsense.functions.time import ts_lit
from fieldsense.operators.filters import page_after
from fieldsense.operators.lookup import add_location
from fieldsense.operators.validate import normalize_utc, parse_documents
from fieldsense.plans import catalog as C
from fieldsense.plans import queries as Q
from fieldsense.plans.catalog import END, ORACLE_SQL, RANGE_1D, RANGE_6H, START, register, with_docs, with_m
from fieldsense.schema import sensor_dim
from fieldsense.sources import events as E
from fieldsense.sources import table as T
from fieldsense.sources.coverage import coverage_store, gap_stats_from_coverage, missing_windows, windows_of
from fieldsense.sources.documents import handed_to, small_files, write_documents
from fieldsense.sources.rollup import connectivity_from_rollup, partials, rollup_store
from fieldsense.streaming.connectivity import maintain
from fieldsense.streaming.ingest import ingest_folder, ingest_stream
from fieldsense.streaming.silence import start_alerts


# ---------------------------------------------------------------- rollup and coverage
def _drops(spark, sf_dir):
    """The measurements in three drops: by time, with rows of all days that come
    late in the last one."""
    m = C._m(spark, sf_dir)
    late = F.pmod(F.xxhash64("sensor_id", "treatment_id", "window_start"), F.lit(11)) == 0
    early = F.col("window_start") < ts_lit(START)
    return [m.where(early & ~late), m.where(~early & ~late), m.where(late)]


def _maintained(spark, sf_dir, store_of, partials_of):
    """A store kept up to date by a stream in three micro-batches."""
    base = C._scratch(spark, "kept")
    store, inbox = store_of(spark, f"{base}/store"), f"{base}/rows"
    for drop in _drops(spark, sf_dir):
        drop.write.mode("append").parquet(inbox)
        rows = spark.readStream.schema(drop.schema).parquet(inbox)
        maintain(rows, store, partials_of, f"{base}/ledger").awaitTermination()
    return store


@register("stream_rollup", ORACLE_SQL["stream_connectivity"])
def q_stream_rollup(spark, sf_dir):
    """Connectivity from a rollup that a stream kept up to date, late rows included."""
    return connectivity_from_rollup(_maintained(spark, sf_dir, rollup_store, partials), *RANGE_6H)


@register("connectivity_1d_rollup", ORACLE_SQL["connectivity_1d"])
def q_connectivity_1d_rollup(spark, sf_dir):
    """One-day bins of a month from the rollup's days: no measurement is read."""
    store = rollup_store(spark, C._scratch(spark, "rollup"))
    store.commit(partials(C._m(spark, sf_dir)))
    return connectivity_from_rollup(store, *RANGE_1D)


_CUT = ("2024-01-05 03:20:00", "2024-01-14 17:47:12")


@register("connectivity_6h_rollup", with_m(", " + C._conn_sql("6 HOUR", *_CUT, C._6H_FILTER).strip() + "\n" + C._CONN_OUT))
def q_connectivity_6h_rollup(spark, sf_dir):
    """A range that cuts bins and hours: hours at its ends, and rows for the parts of an hour."""
    m = C._m(spark, sf_dir)
    store = rollup_store(spark, C._scratch(spark, "rollup"))
    store.commit(partials(m))
    return connectivity_from_rollup(store, *_CUT, locations=["Site 1", "Site 2", "Unknown"], sensor_ids=[1, 3, 4, 8],
                                    measurements=m)


@register("gap_stats_coverage", ORACLE_SQL["gap_stats"])
def q_gap_stats_coverage(spark, sf_dir):
    return gap_stats_from_coverage(_maintained(spark, sf_dir, coverage_store, windows_of), START, END)


@register("missing_windows", with_m(f"""
, s AS (SELECT DISTINCT sensor_id, treatment_id, location FROM m
        WHERE window_start BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
w AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 15 MINUTE)) AS window_start)
SELECT sensor_id, treatment_id, location, window_start FROM s, w
EXCEPT SELECT sensor_id, treatment_id, location, window_start FROM m"""))
def q_missing_windows(spark, sf_dir):
    """The windows that series with rows in the range have none for."""
    store = coverage_store(spark, C._scratch(spark, "coverage"))
    store.commit(windows_of(C._m(spark, sf_dir)))
    return missing_windows(store, START, END)


# ---------------------------------------------------------------- keyset pages
def _nth_page(df, order_by, n):
    """Page ``n`` as a reader gets there: by the last row of each page before."""
    after = None
    for _ in range(n):
        rows = page_after(df, order_by, after).collect()
        if not rows:
            break
        after = rows[-1].asDict()
    return page_after(df, order_by, after)


@register("latest_page_keyset", ORACLE_SQL["latest_page"])
def q_latest_page_keyset(spark, sf_dir):
    path = C._stored_path(spark, sf_dir)
    latest = Q.latest_status(T.read_table(spark, path), T.read_series(spark, path))
    return _nth_page(latest, ["location", "treatment_id", "sensor_id"], 1)


@register("fetch_page_keyset", with_m(f"""
SELECT {C._COLS} FROM m WHERE window_start BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
ORDER BY window_start, sensor_id, treatment_id LIMIT 10 OFFSET 40"""))
def q_fetch_page_keyset(spark, sf_dir):
    """The fifth page of a range on the stored table, in time order."""
    rows = Q.in_range(C._stored(spark, sf_dir), START, END)
    return _nth_page(rows, ["window_start", "sensor_id", "treatment_id"], 4).select(*C._COLS.split(", "))


# ---------------------------------------------------------------- running alerts
@register("stream_silence_alerts", with_m("""
, p AS (SELECT DISTINCT sensor_id, location, window_start FROM m),
g AS (SELECT sensor_id, location, window_start AS last_seen, window_start + INTERVAL 45 MINUTE AS alert_at,
             lead(window_start) OVER (PARTITION BY sensor_id, location ORDER BY window_start) AS next FROM p)
SELECT sensor_id, location, last_seen, alert_at FROM g
WHERE (next IS NULL OR next >= alert_at)
  AND alert_at <= (SELECT max(window_start) FROM p) - INTERVAL 1 HOUR"""))
def q_stream_silence_alerts(spark, sf_dir):
    """Silences of 45 minutes or more as a stream finds them, rows up to an hour late."""
    base = C._scratch(spark, "alerts")
    m = C._m(spark, sf_dir)
    m.write.parquet(f"{base}/rows")
    rows = spark.readStream.schema(m.schema).parquet(f"{base}/rows")
    start_alerts(rows, f"{base}/alerts", f"{base}/ledger", threshold_hours=0.75, delay="1 hour").awaitTermination()
    return spark.read.schema("sensor_id bigint, location string, last_seen timestamp_ntz, alert_at timestamp_ntz").parquet(
        f"{base}/alerts")


# ---------------------------------------------------------------- free-form dates
FORMS = ("EEE MMM dd yyyy HH:mm:ss", "EEEE, MMMM d, yyyy h:mm:ss a", "EEE, dd MMM yyyy HH:mm:ss '+0000'",
         "EEE MMM d HH:mm:ss yyyy", "d'th of' MMMM yyyy 'at' HH:mm:ss", "MMM d'th', yyyy h:mm a", "M/d/yy HH:mm",
         "yyyy-MM-dd h:mm:ss a", "dd-MMM-yyyy HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyyMMddHHmmss",
         "HH:mm:ss d MMMM yyyy", "HH:mm MM/dd/yyyy", "d MMM yyyy HH'h'mm'm'ss's'", "MMM-dd-yyyy HH:mm", "yyyy MMM dd HH:mm",
         "dd MMM yy h:mm a", "yyyy.MM.dd HH:mm", "'on' EEE. d MMM. yyyy, HH:mm", "d/M/yyyy h:mm:ss a", "dd.MM.yy HH:mm:ss",
         "yyyy-MM-dd'T'HH:mm:ss 'UTC+0'", "MMMM d yyyy HH:mm 'Z'", "yyyyMMdd HHmm")


@register("normalize_utc_freeform", with_docs("SELECT DISTINCT file_name, window_start, window_end FROM dr"))
def q_normalize_utc_freeform(spark, sf_dir):
    """Window times rewritten in 24 free forms, by hash of the file name; some as
    local time of a zone that is named or given by its offset."""
    p = parse_documents(E.documents(spark, sf_dir))
    pick = F.pmod(F.xxhash64("file_name"), F.lit(len(FORMS) + 2))
    cols = []
    for c in ("window_start", "window_end"):
        ts = F.try_variant_get("doc", f"$.{c}", "string").cast("timestamp_ntz")
        # the day is only written first where its number tells it from a month
        clear = F.dayofmonth(ts) > 12
        text = F.date_format(ts, FORMS[0])
        for i, f in enumerate(FORMS):
            by_number = f.startswith(("d/M", "dd.MM"))
            text = F.when((pick == i) & (clear if by_number else F.lit(True)), F.date_format(ts, f)).otherwise(text)
        east = F.date_format(ts - F.expr("INTERVAL 5 HOURS"), "EEE, d MMM yyyy h:mm:ss a 'EST'")
        west = F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), "MMMM d'th' yyyy HH:mm:ss '+05:30'")
        text = F.when(pick == len(FORMS), east).when(pick == len(FORMS) + 1, west).otherwise(text)
        cols.append(text.alias(c))
    return normalize_utc(p.select("file_name", *cols), free_form=True)


# ---------------------------------------------------------------- interrupted and watched runs
@register("append_interrupted", with_m(", " + C._LATEST_SQL.strip() + "\nSELECT * FROM latest"))
def q_append_interrupted(spark, sf_dir):
    """Latest status after an append whose rows were written but not their series,
    run again, and with catalog and days compacted."""
    path = C._scratch(spark, "interrupted")
    rows = add_location(E.raw_readings(spark, sf_dir), E.FIXTURE_SENSORS)
    first = rows.where(F.col("window_start") < ts_lit(START))
    T.append_new(first, path, order_by=["event_id"])
    # what a run leaves that is lost after its rows are written
    lost = T.dedup_first(T.with_window_date(rows), ["event_id"]).join(
        T.read_table(spark, path).select(*T.KEY), list(T.KEY), "left_anti")
    T.write_rows(lost.select(*[F.col(f.name).cast(f.dataType) for f in T.TABLE_SCHEMA.fields]), path)
    T.append_new(rows, path, order_by=["event_id"])
    T.compact_series(spark, path)
    days = [r[0] for r in T.read_series(spark, path).select(F.to_date("last_window")).distinct().collect()]
    T.compact_dates(spark, path, days)
    return Q.latest_status(T.read_table(spark, path), T.read_series(spark, path))


@register("ingest_files_archived", with_docs("""
SELECT CAST(count(DISTINCT file_name) AS BIGINT) AS archived, CAST(0 AS BIGINT) AS left_in_inbox,
       CAST(count(DISTINCT (sensor_id, treatment_id, window_start)) FILTER (WHERE NOT doc_bad) AS BIGINT) AS stored
FROM dr""").replace("time_bucket(INTERVAL 15 MINUTE, ts)", "time_bucket(INTERVAL 6 HOUR, ts)"))
def q_ingest_files_archived(spark, sf_dir):
    """Files through the one-shot call and then a watching stream (one batch every
    second), both archiving: how many files lie where, and the rows stored."""
    base = C._scratch(spark, "archived")
    inbox, table, kept = f"{base}/inbox", f"{base}/table", f"{base}/kept"
    docs = E.document_structs(spark, sf_dir, bad_quality_above=C._BAD, width="6 hours")
    part = F.pmod(F.xxhash64("file_name"), F.lit(2))
    write_documents(docs.where(part == 0), inbox)
    ingest_folder(spark, inbox, table, E.FIXTURE_SENSORS, archive_dir=kept)
    write_documents(docs.where(part == 1), inbox)
    q = ingest_stream(spark, inbox, table, f"{base}/ledger", E.FIXTURE_SENSORS, interval_seconds=1,
                      clean_source="archive", archive_dir=kept)
    try:
        q.processAllAvailable()
    finally:
        q.stop()

    def files(folder):
        found = small_files(spark).read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
        return handed_to(spark, found).select("path")

    counts = [files(kept).agg(F.count(F.lit(1)).alias("archived")),
              files(inbox).agg(F.count(F.lit(1)).alias("left_in_inbox")),
              T.read_table(spark, table).agg(F.count(F.lit(1)).alias("stored"))]
    return counts[0].join(counts[1]).join(counts[2])              # one row each


@register("table_in_catalog", with_m(f"SELECT {C._COLS} FROM m"))
def q_table_in_catalog(spark, sf_dir):
    """A catalog table in buckets of the key, created, filled in two appends and read by name."""
    path = C._scratch(spark, "catalog")
    name = "fs_" + path.rsplit("-", 1)[1]
    T.ensure_table(spark, path, name, buckets=4)
    rows = add_location(E.raw_readings(spark, sf_dir), sensor_dim(spark, E.FIXTURE_SENSORS))
    T.append_new(rows.where(F.col("window_start") < ts_lit(START)), path, order_by=["event_id"], table_name=name)
    T.append_new(rows, path, order_by=["event_id"], table_name=name)
    return spark.table(name).select(*C._COLS.split(", "))
