"""Registered queries (Spark) and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, builds the measurement input from the
driver's ``events`` table and runs one library operator or query over the
whole of it. The oracle states the same result in SQL over ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldsense.operators.dedup import dedup_first, insert_if_absent, surrogate_id
from fieldsense.operators.filters import in_range, page, with_filters
from fieldsense.operators.lookup import add_location
from fieldsense.functions.labels import quality_color, treatment_label
from fieldsense.functions.time import day_bounds, time_floor
from fieldsense.plans import queries as Q
from fieldsense.plans import series as S
from fieldsense.sources import events as E

START, END = "2024-01-10 00:00:00", "2024-01-12 23:59:59"
NOW = "2024-01-15 12:00:00"
RANGE_6H = ("2024-01-05 00:00:00", "2024-01-14 23:59:59")     # 10 days -> 6 h bins
RANGE_1D = ("2024-01-01 00:00:00", "2024-01-31 23:59:59")     # 30.99 days -> 1 day bins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- oracle CTEs
_RAW = """
raw AS (
  SELECT event_id,
    CAST(user_id % 8 + 1 AS BIGINT) AS sensor_id,
    CAST(event_id % 3 + 1 AS BIGINT) AS treatment_id,
    CASE WHEN user_id % 8 = 7 THEN 'Unknown' WHEN user_id % 8 < 2 THEN 'Site 1'
         WHEN user_id % 8 < 4 THEN 'Site 2' WHEN user_id % 8 < 6 THEN 'Site 3'
         ELSE 'Site 4' END AS location,
    time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
    time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end,
    CAST(15 AS BIGINT) AS n_observations,
    value AS control_temp,
    value + CAST(1.5 AS DOUBLE) * (event_id % 3 + 1) AS treatment_temp,
    CAST(CASE WHEN k >= 90 THEN 20 + k % 3 ELSE 20 - k % 5 END AS BIGINT) AS received_packets,
    CAST(20 AS BIGINT) AS expected_packets,
    CAST(k + 29 AS DOUBLE) / 128 AS connection_quality
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e
)"""

_M = _RAW + """,
m AS (
  SELECT sensor_id, treatment_id, location, window_start, window_end, n_observations,
         control_temp, treatment_temp, received_packets, expected_packets, connection_quality
  FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, treatment_id, window_start
                                     ORDER BY event_id) AS rn FROM raw) d
  WHERE rn = 1
)"""

_DIM = """
dim AS (
  SELECT CAST(id AS BIGINT) AS sensor_id, location, CAST(pos AS INT) AS pos
  FROM (VALUES (1,'Site 1',0),(2,'Site 1',1),(3,'Site 2',2),(4,'Site 2',3),
               (5,'Site 3',4),(6,'Site 3',5),(7,'Site 4',6),(99,'Site 9',7)) v(id, location, pos)
)"""

_COLS = ("sensor_id, treatment_id, location, window_start, window_end, n_observations, "
         "control_temp, treatment_temp, received_packets, expected_packets, connection_quality")

_LABEL = ("CASE treatment_id WHEN 1 THEN '+1.5°C' WHEN 2 THEN '+3°C' WHEN 3 THEN '+4.5°C' "
          "ELSE 'Treatment ' || CAST(treatment_id AS VARCHAR) END")


def with_m(body: str, dim: bool = False) -> str:
    return "WITH " + _M + ("," + _DIM if dim else "") + "\n" + body


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.measurements(spark, sf_dir)


# ---------------------------------------------------------------- latest status
_LATEST_SQL = """
latest AS (
  SELECT * EXCLUDE (n_observations) FROM m
  QUALIFY rank() OVER (PARTITION BY treatment_id, location ORDER BY window_start DESC) = 1
)"""


@register("latest_status", with_m(", " + _LATEST_SQL.strip() + "\nSELECT * FROM latest"))
def q_latest_status(spark, sf_dir):
    return Q.latest_status(_m(spark, sf_dir))


@register("latest_status_display", with_m(", " + _LATEST_SQL.strip() + f"""
SELECT location, treatment_id, sensor_id,
       strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end,
       round_even(control_temp * 100, 0) / 100 AS control_temp,
       round_even(treatment_temp * 100, 0) / 100 AS treatment_temp,
       received_packets, expected_packets,
       round_even(connection_quality * 1000, 0) / 1000 AS connection_quality,
       {_LABEL} AS treatment_label
FROM latest"""))
def q_latest_status_display(spark, sf_dir):
    return Q.latest_status_display(_m(spark, sf_dir))


@register("latest_page", with_m(", " + _LATEST_SQL.strip() + """
SELECT * FROM latest ORDER BY location, treatment_id, sensor_id LIMIT 10 OFFSET 10"""))
def q_latest_page(spark, sf_dir):
    return page(Q.latest_status(_m(spark, sf_dir)), ["location", "treatment_id", "sensor_id"], 1)


# ---------------------------------------------------------------- filters, range fetch
@register("range_filter", with_m(f"""
SELECT {_COLS} FROM m
WHERE window_start BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""))
def q_range_filter(spark, sf_dir):
    return in_range(_m(spark, sf_dir), START, END)


@register("in_list_filter", with_m(f"""
SELECT {_COLS} FROM m
WHERE location IN ('Site 1', 'Site 3') AND sensor_id IN (1, 2, 5, 8) AND treatment_id IN (1, 3)"""))
def q_in_list_filter(spark, sf_dir):
    return with_filters(_m(spark, sf_dir), locations=["Site 1", "Site 3"],
                        sensor_ids=[1, 2, 5, 8], treatment_ids=[1, 3])


@register("min_quality_filter", with_m(f"""
SELECT {_COLS} FROM m WHERE connection_quality >= 0.75"""))
def q_min_quality_filter(spark, sf_dir):
    return with_filters(_m(spark, sf_dir), min_quality=0.75)


_ID_SQL = ("md5(CAST(sensor_id AS VARCHAR) || '|' || CAST(treatment_id AS VARCHAR) || '|' || "
           "strftime(window_start, '%Y-%m-%d %H:%M:%S'))")


@register("fetch_measurements", with_m(f"""
SELECT {_ID_SQL} AS id, {_COLS} FROM m
WHERE window_start BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
  AND location IN ('Site 2', 'Unknown') AND treatment_id IN (2, 3) AND connection_quality >= 0.5"""))
def q_fetch_measurements(spark, sf_dir):
    return Q.fetch_measurements(_m(spark, sf_dir), START, END, locations=["Site 2", "Unknown"],
                                treatment_ids=[2, 3], min_quality=0.5)


@register("day_range", with_m(f"""
SELECT {_ID_SQL} AS id, {_COLS} FROM m
WHERE window_start BETWEEN TIMESTAMP '2024-01-19 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'"""))
def q_day_range(spark, sf_dir):
    lo, hi = day_bounds(None, "2024-01-21", today="2024-01-19")
    return Q.fetch_measurements(_m(spark, sf_dir), lo, hi)


@register("surrogate_id", with_m(f"SELECT sensor_id, treatment_id, window_start, {_ID_SQL} AS id FROM m"))
def q_surrogate_id(spark, sf_dir):
    return _m(spark, sf_dir).select("sensor_id", "treatment_id", "window_start", surrogate_id().alias("id"))


# ---------------------------------------------------------------- facets
@register("distinct_locations", with_m("SELECT DISTINCT location FROM m"))
def q_distinct_locations(spark, sf_dir):
    return Q.distinct_locations(_m(spark, sf_dir))


@register("distinct_sensors", with_m("SELECT DISTINCT sensor_id FROM m"))
def q_distinct_sensors(spark, sf_dir):
    return Q.distinct_sensors(_m(spark, sf_dir))


@register("distinct_treatments", with_m("SELECT DISTINCT treatment_id FROM m"))
def q_distinct_treatments(spark, sf_dir):
    return Q.distinct_treatments(_m(spark, sf_dir))


@register("sensors_by_location", with_m(
    "SELECT DISTINCT sensor_id FROM m WHERE location IN ('Site 2', 'Unknown')"))
def q_sensors_by_location(spark, sf_dir):
    return Q.sensors_by_location(_m(spark, sf_dir), ["Site 2", "Unknown"])


@register("treatments_by_location_sensor", with_m(
    "SELECT DISTINCT treatment_id FROM m WHERE location IN ('Site 1') AND sensor_id IN (2)"))
def q_treatments_by(spark, sf_dir):
    return Q.treatments_by(_m(spark, sf_dir), ["Site 1"], [2])


@register("filter_options", with_m(f"""
SELECT DISTINCT 'location' AS facet, location AS label, location AS value FROM m
UNION ALL
SELECT DISTINCT 'sensor' AS facet, 'Sensor ' || CAST(sensor_id AS VARCHAR) AS label,
       CAST(sensor_id AS VARCHAR) AS value FROM m WHERE location IN ('Site 3')
UNION ALL
SELECT DISTINCT 'treatment' AS facet, {_LABEL} AS label, CAST(treatment_id AS VARCHAR) AS value
FROM m WHERE location IN ('Site 3') AND sensor_id IN (5)"""))
def q_filter_options(spark, sf_dir):
    return S.filter_options(_m(spark, sf_dir), ["Site 3"], [5])


# ---------------------------------------------------------------- gap statistics
_GAP_SQL = f"""
gaps AS (
  SELECT sensor_id, treatment_id, location, CAST(288 AS BIGINT) AS expected_count,
         CAST(count(*) AS BIGINT) AS actual_count,
         CAST(greatest(288 - count(*), 0) AS BIGINT) AS missing_count
  FROM m WHERE window_start BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
  GROUP BY sensor_id, treatment_id, location
)"""


@register("gap_stats", with_m(", " + _GAP_SQL.strip() + "\nSELECT * FROM gaps"))
def q_gap_stats(spark, sf_dir):
    return Q.gap_stats(_m(spark, sf_dir), START, END)


@register("gaps_only", with_m(", " + _GAP_SQL.strip() + """
SELECT 'S' || CAST(sensor_id AS VARCHAR) || '/T' || CAST(treatment_id AS VARCHAR) AS label,
       sensor_id, treatment_id, missing_count
FROM gaps WHERE missing_count > 0"""))
def q_gaps_only(spark, sf_dir):
    return Q.gaps_only(Q.gap_stats(_m(spark, sf_dir), START, END))


# ---------------------------------------------------------------- connectivity
def _conn_sql(width: str, lo: str, hi: str, extra: str = "") -> str:
    return f"""
conn AS (
  SELECT time_bucket(INTERVAL {width}, window_start) AS time_bin, sensor_id, location,
         CAST(sum(received_packets) AS BIGINT) AS received_count,
         CAST(sum(expected_packets) AS BIGINT) AS expected_count,
         avg(connection_quality) AS avg_quality
  FROM m WHERE window_start BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}' {extra}
  GROUP BY ALL
)"""


_CONN_OUT = ("SELECT time_bin, sensor_id, location, received_count, expected_count, avg_quality, "
             "least(received_count / greatest(expected_count, 1), 1.0) AS ratio FROM conn")
_6H_FILTER = "AND location IN ('Site 1', 'Site 2', 'Unknown') AND sensor_id IN (1, 3, 4, 8)"


@register("connectivity_1h", with_m(", " + _conn_sql("1 HOUR", START, END).strip() + "\n" + _CONN_OUT))
def q_connectivity_1h(spark, sf_dir):
    return Q.connectivity_stats(_m(spark, sf_dir), START, END)


@register("connectivity_6h", with_m(", " + _conn_sql("6 HOUR", *RANGE_6H, _6H_FILTER).strip() + "\n" + _CONN_OUT))
def q_connectivity_6h(spark, sf_dir):
    return Q.connectivity_stats(_m(spark, sf_dir), *RANGE_6H, locations=["Site 1", "Site 2", "Unknown"],
                                sensor_ids=[1, 3, 4, 8])


@register("connectivity_1d", with_m(", " + _conn_sql("1 DAY", *RANGE_1D).strip() + "\n" + _CONN_OUT))
def q_connectivity_1d(spark, sf_dir):
    return Q.connectivity_stats(_m(spark, sf_dir), *RANGE_1D)


@register("time_floor", with_m("""
SELECT sensor_id, treatment_id, window_start,
       time_bucket(INTERVAL 1 HOUR, window_start) AS bin_1h,
       time_bucket(INTERVAL 6 HOUR, window_start) AS bin_6h,
       time_bucket(INTERVAL 1 DAY, window_start) AS bin_1d
FROM m"""))
def q_time_floor(spark, sf_dir):
    ws = F.col("window_start")
    return (_m(spark, sf_dir).select("sensor_id", "treatment_id", "window_start")
            .withColumn("bin_1h", time_floor(ws, "1 hour"))
            .withColumn("bin_6h", time_floor(ws, "6 hours"))
            .withColumn("bin_1d", time_floor(ws, "1 day")))


_COLOR_SQL = ("CASE WHEN avg_quality IS NULL OR isnan(avg_quality) THEN 'rgb(128,128,128)' ELSE "
              "'rgb(' || CAST(CAST(trunc(255 * (1.0 - least(greatest(avg_quality / 1.0, 0.0), 1.0))) AS INT) AS VARCHAR)"
              " || ',' || CAST(CAST(trunc(255 * least(greatest(avg_quality / 1.0, 0.0), 1.0)) AS INT) AS VARCHAR)"
              " || ',0)' END")


@register("quality_color", with_m(", " + _conn_sql("1 DAY", *RANGE_1D).strip() + f"""
SELECT time_bin, sensor_id, location, avg_quality, {_COLOR_SQL} AS color FROM conn"""))
def q_quality_color(spark, sf_dir):
    st = Q.connectivity_stats(_m(spark, sf_dir), *RANGE_1D)
    return st.select("time_bin", "sensor_id", "location", "avg_quality",
                     quality_color(F.col("avg_quality")).alias("color"))


@register("connectivity_series", with_m(", " + _conn_sql("6 HOUR", *RANGE_6H, _6H_FILTER).strip() + f""",
st AS ({_CONN_OUT})
SELECT 'Sensor ' || CAST(sensor_id AS VARCHAR) || ' (' ||
         first_value(location) OVER (PARTITION BY sensor_id ORDER BY time_bin, location) || ')' AS series,
       sensor_id, time_bin, location, ratio,
       {_COLOR_SQL} AS color,
       CAST(CAST(round_even(ratio * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS ratio_text,
       printf('%.2f', avg_quality) AS quality_text,
       CAST(received_count AS VARCHAR) || ' / ' || CAST(expected_count AS VARCHAR) AS packets_text
FROM st"""))
def q_connectivity_series(spark, sf_dir):
    st = Q.connectivity_rows(_m(spark, sf_dir), *RANGE_6H, locations=["Site 1", "Site 2", "Unknown"],
                             sensor_ids=[1, 3, 4, 8])
    return S.connectivity_series(st)


# ---------------------------------------------------------------- silence detection
_LO24 = "2024-01-14 12:00:00"
_GAPS_SQL = f"""
pts AS (
  SELECT DISTINCT sensor_id, location, window_start FROM m
  WHERE window_start BETWEEN TIMESTAMP '{_LO24}' AND TIMESTAMP '{NOW}'
),
steps AS (
  SELECT sensor_id, location, window_start,
         date_diff('second', coalesce(lag(window_start) OVER (PARTITION BY sensor_id, location ORDER BY window_start),
                                      TIMESTAMP '{_LO24}'), window_start) AS gap
  FROM pts
),
mg AS (
  SELECT sensor_id, location, max(window_start) AS last_seen,
         CAST(greatest(max(gap), date_diff('second', max(window_start), TIMESTAMP '{NOW}')) AS BIGINT) AS max_gap_s
  FROM steps GROUP BY sensor_id, location
),
silent AS (
  SELECT sensor_id, coalesce(location, 'unknown') AS location, pos FROM dim
  WHERE sensor_id NOT IN (SELECT sensor_id FROM pts)
),
alerts AS (
  SELECT sensor_id, location, max_gap_s, CAST(printf('%.1f', max_gap_s / 3600.0) AS DOUBLE) AS max_gap_hours,
         0 AS kind, CAST(NULL AS INT) AS pos
  FROM mg WHERE max_gap_s >= 3.0 * 3600
  UNION ALL
  SELECT sensor_id, location, CAST(86400 AS BIGINT), CAST(printf('%.1f', 86400 / 3600.0) AS DOUBLE), 1, pos FROM silent
)"""


@register("max_gap", with_m(", " + _GAPS_SQL.strip() + "\nSELECT * FROM mg", dim=True))
def q_max_gap(spark, sf_dir):
    return Q.max_gap(_m(spark, sf_dir), NOW)


@register("silent_sensors", with_m(", " + _GAPS_SQL.strip() + "\nSELECT * FROM silent", dim=True))
def q_silent_sensors(spark, sf_dir):
    return Q.silent_sensors(_m(spark, sf_dir), E.fixture_sensors(spark), NOW)


@register("sensor_gaps", with_m(", " + _GAPS_SQL.strip() + "\nSELECT * FROM alerts", dim=True))
def q_sensor_gaps(spark, sf_dir):
    return Q.sensor_gaps(_m(spark, sf_dir), E.fixture_sensors(spark), NOW)


@register("gap_alert_text", with_m(", " + _GAPS_SQL.strip() + """
SELECT CAST(count(*) AS BIGINT) AS n_alerts,
       coalesce(string_agg('Sensor ' || CAST(sensor_id AS VARCHAR) || ' (' || location || '): ' ||
                  CAST(max_gap_hours AS VARCHAR) || ' h without signal', '; '
                  ORDER BY kind, pos NULLS FIRST, sensor_id, location), '') AS text
FROM alerts""", dim=True))
def q_gap_alert_text(spark, sf_dir):
    return S.gap_alert_text(Q.gap_rows(_m(spark, sf_dir), E.fixture_sensors(spark), NOW))


# ---------------------------------------------------------------- temperature series
_CONTROL_SQL = """
ctl AS (
  SELECT 'Control' AS series, CAST(NULL AS BIGINT) AS treatment_id, sensor_id, window_start,
         arg_min(control_temp, treatment_id) AS value
  FROM m GROUP BY sensor_id, window_start
)"""


@register("control_series", with_m(", " + _CONTROL_SQL.strip() + "\nSELECT * FROM ctl"))
def q_control_series(spark, sf_dir):
    return S.control_series(_m(spark, sf_dir))


@register("series_absolute", with_m(", " + _CONTROL_SQL.strip() + f"""
SELECT * FROM ctl
UNION ALL
SELECT {_LABEL} AS series, treatment_id, sensor_id, window_start, treatment_temp AS value
FROM m WHERE treatment_id IN (1, 3)"""))
def q_series_absolute(spark, sf_dir):
    return S.temperature_series(_m(spark, sf_dir), treatment_ids=[1, 3], mode="absolute")


@register("series_delta", with_m(f"""
SELECT {_LABEL} AS series, treatment_id, sensor_id, window_start, treatment_temp - control_temp AS value
FROM m"""))
def q_series_delta(spark, sf_dir):
    return S.temperature_series(_m(spark, sf_dir), mode="delta")


@register("treatment_label", with_m(f"""
SELECT sensor_id, treatment_id, window_start, {_LABEL} AS label,
       'Treatment ' || CAST(sensor_id AS VARCHAR) AS sensor_as_treatment
FROM m"""))
def q_treatment_label(spark, sf_dir):
    # labels for configured ids and the default text for ids without a label
    return _m(spark, sf_dir).select(
        "sensor_id", "treatment_id", "window_start",
        treatment_label(F.col("treatment_id")).alias("label"),
        treatment_label(F.col("sensor_id"), labels={}).alias("sensor_as_treatment"))


# ---------------------------------------------------------------- de-duplication, lookup
@register("dedup_first", "WITH " + _RAW + """
SELECT event_id, sensor_id, treatment_id, location, window_start, window_end, n_observations,
       control_temp, treatment_temp, received_packets, expected_packets, connection_quality
FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, treatment_id, window_start
                                   ORDER BY event_id) AS rn FROM raw) d WHERE rn = 1""")
def q_dedup_first(spark, sf_dir):
    return dedup_first(E.raw_measurements(spark, sf_dir), order_by=["event_id"])


_CUT = "2024-01-16 00:00:00"


@register("insert_if_absent", "WITH " + _RAW + f""",
stored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, treatment_id, window_start
                                              ORDER BY event_id) AS rn
                 FROM raw WHERE window_start < TIMESTAMP '{_CUT}') s WHERE rn = 1
),
batch AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, treatment_id, window_start
                                              ORDER BY event_id) AS rn
                 FROM raw WHERE window_start >= TIMESTAMP '2024-01-10 00:00:00') b WHERE rn = 1
)
SELECT event_id, sensor_id, treatment_id, location, window_start, window_end, n_observations,
       control_temp, treatment_temp, received_packets, expected_packets, connection_quality
FROM batch b WHERE NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.sensor_id = b.sensor_id AND s.treatment_id = b.treatment_id
                           AND s.window_start = b.window_start)""")
def q_insert_if_absent(spark, sf_dir):
    """Stored: the table built from all windows before 2024-01-16; batch: all
    readings from 2024-01-10 on (the overlapping days arrive again). Result:
    the rows the append would insert."""
    raw = E.raw_measurements(spark, sf_dir)
    stored = dedup_first(raw.where(F.col("window_start") < F.lit(_CUT).cast("timestamp_ntz")), ["event_id"])
    batch = raw.where(F.col("window_start") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return insert_if_absent(batch, stored, order_by=["event_id"])


@register("add_location", "WITH " + _RAW + """
SELECT event_id, sensor_id, treatment_id, location, window_start FROM raw""")
def q_add_location(spark, sf_dir):
    """The lookup with a dimension DataFrame; the measurement keys give the
    configuration list."""
    readings = E.raw_readings(spark, sf_dir)
    return add_location(readings, E.fixture_sensors(spark)).select(
        "event_id", "sensor_id", "treatment_id", "location", "window_start")


# ---------------------------------------------------------------- documents and ingest
from fieldsense.operators.validate import (flatten_documents, normalize_utc,  # noqa: E402
                                           parse_documents, quality_ok, split_rejects,
                                           treatment_error, validate_documents)
from fieldsense.plans.ingest import ingest_stats  # noqa: E402
from fieldsense.schema import empty_measurements  # noqa: E402

_BAD = 150.0        # documents with a control temperature above this get quality 1.5
_RANGE_ERR = "Connection quality 1.5 out of valid range (0.0-1.0)"

_DOCS_SQL = """
dr AS (
  SELECT * EXCLUDE (n),
         'site' || CAST(sensor_id AS VARCHAR) || '_' || strftime(window_start, '%Y%m%dT%H%M%S') || '_'
           || printf('%03d', n // 3) || '.json' AS file_name,
         CAST(n % 3 AS INT) AS pos,
         max(control_temp) OVER (PARTITION BY sensor_id, window_start, n // 3) > 150 AS doc_bad
  FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, window_start ORDER BY event_id) - 1 AS n FROM raw) x
)"""


def with_docs(body: str) -> str:
    return "WITH " + _RAW + "," + _DOCS_SQL + "\n" + body


def _validated(spark, sf_dir, offset=None, bad=None):
    return validate_documents(parse_documents(E.documents(spark, sf_dir, offset=offset, bad_quality_above=bad)))


@register("parse_documents", with_docs("""
SELECT file_name, sensor_id AS site_id, CAST(count(*) AS INT) AS n_treatments FROM dr GROUP BY ALL"""))
def q_parse_documents(spark, sf_dir):
    p = parse_documents(E.documents(spark, sf_dir))
    return p.select("file_name", F.try_variant_get("doc", "$.site_id", "bigint").alias("site_id"),
                    F.size(F.try_variant_get("doc", "$.treatments", "array<variant>")).alias("n_treatments"))


@register("flatten_documents", with_docs(f"SELECT file_name, pos, {_COLS.replace('location, ', '')} FROM dr"))
def q_flatten_documents(spark, sf_dir):
    valid, _ = split_rejects(_validated(spark, sf_dir))
    return flatten_documents(valid)


@register("normalize_utc", with_docs("SELECT DISTINCT file_name, window_start, window_end FROM dr"))
def q_normalize_utc(spark, sf_dir):
    # window times are written as local time with a +02:00 offset
    p = parse_documents(E.documents(spark, sf_dir, offset="+02:00"))
    text = p.select("file_name",
                    F.try_variant_get("doc", "$.window_start", "string").alias("window_start"),
                    F.try_variant_get("doc", "$.window_end", "string").alias("window_end"))
    return normalize_utc(text)


@register("validate_documents", with_docs(f"""
SELECT DISTINCT file_name, CASE WHEN doc_bad THEN '{_RANGE_ERR}' END AS error FROM dr"""))
def q_validate_documents(spark, sf_dir):
    return _validated(spark, sf_dir, bad=_BAD).select("file_name", "error")


@register("quality_range", with_docs("""
SELECT file_name, pos, CASE WHEN control_temp > 150 THEN 1.5 ELSE connection_quality END AS connection_quality,
       NOT (control_temp > 150) AS quality_ok
FROM dr"""))
def q_quality_range(spark, sf_dir):
    p = parse_documents(E.documents(spark, sf_dir, bad_quality_above=_BAD))
    t = p.select("file_name", F.posexplode(F.try_variant_get("doc", "$.treatments", "array<variant>"))
                 .alias("pos", "t"))
    q = F.try_variant_get("t", "$.connection_quality", "double")
    return t.select("file_name", "pos", q.alias("connection_quality"), quality_ok(q).alias("quality_ok"))


@register("whole_document_reject", with_docs(f"""
SELECT file_name, CAST(count(*) AS INT) AS n_treatments, CAST(count_if(control_temp > 150) AS INT) AS n_bad,
       '{_RANGE_ERR}' AS error
FROM dr WHERE doc_bad GROUP BY file_name"""))
def q_whole_document_reject(spark, sf_dir):
    v = _validated(spark, sf_dir, bad=_BAD).where(F.col("error").isNotNull())
    return v.select("file_name", F.size("treatments").alias("n_treatments"),
                    F.size(F.filter("treatments", lambda t: treatment_error(t).isNotNull())).alias("n_bad"),
                    "error")


@register("split_rejects", with_docs(f"""
SELECT DISTINCT file_name, '{_RANGE_ERR}' AS error FROM dr WHERE doc_bad"""))
def q_split_rejects(spark, sf_dir):
    _, rejects = split_rejects(_validated(spark, sf_dir, bad=_BAD))
    return rejects.select("file_name", "error")


def _ingest_rows(spark, validated):
    valid, _ = split_rejects(validated)
    rows = add_location(flatten_documents(valid), E.FIXTURE_SENSORS)
    return insert_if_absent(rows, empty_measurements(spark), order_by=["file_name", "pos"])


@register("ingest_rows", with_docs(f"""
SELECT {_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, treatment_id, window_start ORDER BY file_name, pos) AS rn
  FROM dr WHERE NOT doc_bad) x
WHERE rn = 1"""))
def q_ingest_rows(spark, sf_dir):
    return _ingest_rows(spark, _validated(spark, sf_dir, bad=_BAD)).select(*_COLS.split(", "))


@register("ingest_stats", with_docs("""
SELECT CAST(count(DISTINCT file_name) AS BIGINT) AS found,
       CAST(count(DISTINCT file_name) FILTER (WHERE NOT doc_bad) AS BIGINT) AS parsed,
       CAST(count(DISTINCT file_name) FILTER (WHERE doc_bad) AS BIGINT) AS dropped,
       CAST(count(*) FILTER (WHERE NOT doc_bad) AS BIGINT) AS rows,
       CAST(count(DISTINCT (sensor_id, treatment_id, window_start)) FILTER (WHERE NOT doc_bad) AS BIGINT) AS inserted,
       CAST(count(*) FILTER (WHERE NOT doc_bad)
            - count(DISTINCT (sensor_id, treatment_id, window_start)) FILTER (WHERE NOT doc_bad) AS BIGINT) AS duplicates
FROM dr"""))
def q_ingest_stats(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    # documents are validated once; the counters, the rows and their keys read what was saved
    validated = _validated(spark, sf_dir, bad=_BAD).drop("doc", "treatments").checkpoint()
    return ingest_stats(validated, _ingest_rows(spark, validated))


# ---------------------------------------------------------------- streaming
import uuid  # noqa: E402

from fieldsense.session import ensure_checkpoint_dir  # noqa: E402
from fieldsense.sources.documents import write_documents  # noqa: E402
from fieldsense.sources.table import append_new, read_series, read_table  # noqa: E402
from fieldsense.streaming.ingest import ingest_folder, ingest_stream  # noqa: E402
from fieldsense.streaming.connectivity import start_parquet_sink, stream_connectivity  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldsense-{name}-{uuid.uuid4().hex}"


def _stream_ingest_events(spark, sf_dir) -> str:
    """Stream ``events.parquet`` into a new measurements table; returns its path.

    Each micro-batch is reshaped, located and appended with insert-if-absent
    (``append_new``) inside ``foreachBatch``; ``availableNow`` drains the source.
    """
    base = _scratch(spark, "stream")
    table, ckpt = f"{base}/table", f"{base}/checkpoint"
    sensors = E.FIXTURE_SENSORS
    src = (spark.readStream.schema(E.EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
           .option("maxFilesPerTrigger", 1).parquet(sf_dir))

    def run(batch, epoch_id):
        append_new(add_location(E.readings_from_events(batch), sensors), table, order_by=["event_id"])

    q = (src.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return table


@register("stream_ingest", with_m(f"SELECT {_COLS} FROM m"))
def q_stream_ingest(spark, sf_dir):
    table = _stream_ingest_events(spark, sf_dir)
    return read_table(spark, table).select(*_COLS.split(", "))


@register("stream_connectivity", with_m(", " + _conn_sql("6 HOUR", *RANGE_6H).strip() + "\n" + _CONN_OUT))
def q_stream_connectivity(spark, sf_dir):
    from fieldsense.sources.table import TABLE_SCHEMA
    table = _stream_ingest_events(spark, sf_dir)
    rows = spark.readStream.schema(TABLE_SCHEMA).parquet(table)
    out = _scratch(spark, "conn")
    q = start_parquet_sink(stream_connectivity(rows, *RANGE_6H), out, out + "-ledger")
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_connectivity_watermark", with_m(", " + _conn_sql("6 HOUR", *RANGE_6H).strip() + f"""
SELECT * FROM ({_CONN_OUT}) c
WHERE time_bin + INTERVAL 6 HOUR <= (SELECT max(window_start) FROM m
                                     WHERE window_start BETWEEN TIMESTAMP '{RANGE_6H[0]}'
                                                            AND TIMESTAMP '{RANGE_6H[1]}') - INTERVAL 3 HOUR"""))
def q_stream_connectivity_watermark(spark, sf_dir):
    """Append mode with a 3 hour watermark: only bins closed by the watermark
    (latest row in range minus 3 h) are emitted; their state is dropped."""
    from fieldsense.sources.table import TABLE_SCHEMA
    table = _stream_ingest_events(spark, sf_dir)
    rows = spark.readStream.schema(TABLE_SCHEMA).parquet(table)
    out = _scratch(spark, "connw")
    agg = stream_connectivity(rows, *RANGE_6H, watermark="3 hours")
    q = start_parquet_sink(agg, out, out + "-ledger", output_mode="append")
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(out)


def _stored_path(spark, sf_dir) -> str:
    """The readings appended (insert-if-absent) to a new date-partitioned
    table under the checkpoint folder."""
    table = _scratch(spark, "table")
    append_new(add_location(E.raw_readings(spark, sf_dir), E.FIXTURE_SENSORS), table, order_by=["event_id"])
    return table


def _stored(spark, sf_dir):
    return read_table(spark, _stored_path(spark, sf_dir))


@register("latest_status_stored", with_m(", " + _LATEST_SQL.strip() + "\nSELECT * FROM latest"))
def q_latest_status_stored(spark, sf_dir):
    """Latest status on the stored table: the latest windows come from the
    series catalog, the rows from the date partitions that hold them."""
    path = _stored_path(spark, sf_dir)
    return Q.latest_status(read_table(spark, path), read_series(spark, path))


@register("connectivity_6h_stored", ORACLE_SQL["connectivity_6h"])
def q_connectivity_6h_stored(spark, sf_dir):
    """Connectivity on the stored table: the range prunes date partitions."""
    return Q.connectivity_stats(_stored(spark, sf_dir), *RANGE_6H, locations=["Site 1", "Site 2", "Unknown"],
                                sensor_ids=[1, 3, 4, 8])


@register("sensor_gaps_stored", ORACLE_SQL["sensor_gaps"])
def q_sensor_gaps_stored(spark, sf_dir):
    """Silence alerts on the stored table: one scan of the look-back days."""
    return Q.sensor_gaps(_stored(spark, sf_dir), E.fixture_sensors(spark), NOW)


# facets on the series catalog: no scan of the table
def _series(spark, sf_dir):
    return read_series(spark, _stored_path(spark, sf_dir))


@register("distinct_locations_stored", ORACLE_SQL["distinct_locations"])
def q_distinct_locations_stored(spark, sf_dir):
    return Q.distinct_locations(_series(spark, sf_dir))


@register("distinct_sensors_stored", ORACLE_SQL["distinct_sensors"])
def q_distinct_sensors_stored(spark, sf_dir):
    return Q.distinct_sensors(_series(spark, sf_dir))


@register("distinct_treatments_stored", ORACLE_SQL["distinct_treatments"])
def q_distinct_treatments_stored(spark, sf_dir):
    return Q.distinct_treatments(_series(spark, sf_dir))


@register("filter_options_stored", ORACLE_SQL["filter_options"])
def q_filter_options_stored(spark, sf_dir):
    return S.filter_options(_series(spark, sf_dir), ["Site 3"], [5])


# ---------------------------------------------------------------- one sensor per user
_USER_RAW = _RAW.replace("CAST(user_id % 8 + 1 AS BIGINT) AS sensor_id", "CAST(user_id AS BIGINT) AS sensor_id").replace(
    """CASE WHEN user_id % 8 = 7 THEN 'Unknown' WHEN user_id % 8 < 2 THEN 'Site 1'
         WHEN user_id % 8 < 4 THEN 'Site 2' WHEN user_id % 8 < 6 THEN 'Site 3'
         ELSE 'Site 4' END AS location""",
    "CASE WHEN user_id % 2 = 0 THEN 'Site ' || CAST(user_id // 10 AS VARCHAR) ELSE 'Unknown' END AS location")


def _user_readings(spark, sf_dir):
    readings = E.readings_from_events(E.read_events(spark, sf_dir), sensor_per_user=True)
    return add_location(readings, E.user_sensors(spark, sf_dir))


@register("add_location_large", "WITH " + _USER_RAW + """
SELECT event_id, sensor_id, treatment_id, location, window_start FROM raw""")
def q_add_location_large(spark, sf_dir):
    """The lookup with a dimension that grows with the input."""
    return _user_readings(spark, sf_dir).select("event_id", "sensor_id", "treatment_id", "location", "window_start")


@register("append_twice", "WITH " + _USER_RAW + f"""
SELECT {_COLS} FROM raw
WHERE window_start < TIMESTAMP '{_CUT}' OR window_start >= TIMESTAMP '2024-01-10 00:00:00'
QUALIFY row_number() OVER (PARTITION BY sensor_id, treatment_id, window_start
                           ORDER BY window_start >= TIMESTAMP '{_CUT}', event_id) = 1""")
def q_append_twice(spark, sf_dir):
    """Two appends to one table: all windows before 2024-01-16, then those from
    2024-01-10 on and, again, the very first day. Overlapping days and the
    stray old day add nothing that is stored."""
    raw = _user_readings(spark, sf_dir)
    ws = F.col("window_start")

    def at(text):
        return F.lit(text).cast("timestamp_ntz")

    path = _scratch(spark, "twice")
    append_new(raw.where(ws < at(_CUT)), path, order_by=["event_id"])
    first_day = E.read_events(spark, sf_dir).agg(F.min(F.to_date("ts")).alias("d"))
    again = raw.where(ws >= at("2024-01-10 00:00:00")).unionByName(
        raw.where(ws < at("2024-01-10 00:00:00")).join(first_day, F.to_date("window_start") == F.col("d"), "left_semi"))
    append_new(again, path, order_by=["event_id"])
    return read_table(spark, path).select(*_COLS.split(", "))


# ---------------------------------------------------------------- files through the real ingest
def _drops(spark, sf_dir):
    """The documents (bad ones too) in two drops: two thirds of them, then the
    last third and, once more, a twelfth of all. As in a real inbox one file
    holds one document and files arrive in any time order. Windows begin every
    six hours, so that documents are full and keys repeat across files."""
    docs = E.document_structs(spark, sf_dir, bad_quality_above=_BAD, width="6 hours")
    part = F.pmod(F.xxhash64("file_name"), F.lit(12))
    return docs.where(part < 8), docs.where(part >= 7)


@register("ingest_files", with_docs("""
SELECT DISTINCT sensor_id, treatment_id, location, window_start FROM dr WHERE NOT doc_bad""").replace(
    "time_bucket(INTERVAL 15 MINUTE, ts)", "time_bucket(INTERVAL 6 HOUR, ts)"))
def q_ingest_files(spark, sf_dir):
    """Files through the real ingest into one inbox: the first drop by the
    one-shot call, which empties the inbox, the second by the stream in several
    micro-batches. Re-sent and late documents are among them."""
    base = _scratch(spark, "files")
    inbox, table = f"{base}/inbox", f"{base}/table"
    first, second = _drops(spark, sf_dir)
    write_documents(first, inbox)
    ingest_folder(spark, inbox, table, E.FIXTURE_SENSORS)
    write_documents(second, inbox)
    ingest_stream(spark, inbox, table, f"{base}/ledger", E.FIXTURE_SENSORS, once=True,
                  max_files_per_trigger=2500).awaitTermination()
    return read_table(spark, table).select("sensor_id", "treatment_id", "location", "window_start")


@register("normalize_utc_formats", with_docs("SELECT DISTINCT file_name, window_start, window_end FROM dr"))
def q_normalize_utc_formats(spark, sf_dir):
    """Window times rewritten in eight forms, by hash of the file name."""
    fmts = ["yyyyMMdd'T'HHmmss", "yyyy/MM/dd HH:mm", "d.M.yyyy HH:mm:ss", "MMM dd yyyy HH:mm", "dd MMM yyyy HH:mm:ss",
            "yyyy-MM-dd HH:mm 'UTC'", "yyyy-MM-dd'T'HH:mm:ss'z'", "yyyy-MM-dd HH:mm:ss.SSS"]
    p = parse_documents(E.documents(spark, sf_dir))
    pick = F.pmod(F.xxhash64("file_name"), F.lit(len(fmts)))
    cols = []
    for c in ("window_start", "window_end"):
        ts = F.try_variant_get("doc", f"$.{c}", "string").cast("timestamp_ntz")
        # day and month by numbers are only written where the day tells them apart
        clear = F.dayofmonth(ts) > 12
        text = F.date_format(ts, fmts[0])
        for i, f in enumerate(fmts):
            use = (pick == i) & (clear if f.startswith("d.") else F.lit(True))
            text = F.when(use, F.date_format(ts, f)).otherwise(text)
        cols.append(text.alias(c))
    return normalize_utc(p.select("file_name", *cols))


# ---------------------------------------------------------------- output order
def _positions(df, *cols):
    """Place of every row in the output with the columns it is ordered by.

    The ordered output is saved once with ids that name the partition (upper bits) and
    the place in it; only the partitions' row counts meet in one task.
    """
    ensure_checkpoint_dir(df.sparkSession)
    saved = df.select(F.monotonically_increasing_id().alias("_at"), *cols).checkpoint()
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (saved.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (saved.select("*", part).join(F.broadcast(offsets), "_part")        # one row per partition
            .select((F.col("_before") + inside + 1).cast("bigint").alias("place"), *cols))


@register("order_fetch", with_m(f"""
SELECT CAST(row_number() OVER (ORDER BY window_start) AS BIGINT) AS place, window_start FROM m
WHERE window_start BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""))
def q_order_fetch(spark, sf_dir):
    return _positions(Q.fetch_measurements(_m(spark, sf_dir), START, END), "window_start")


@register("order_latest", with_m(", " + _LATEST_SQL.strip() + """
SELECT CAST(row_number() OVER (ORDER BY location, treatment_id, sensor_id) AS BIGINT) AS place,
       location, treatment_id, sensor_id FROM latest"""))
def q_order_latest(spark, sf_dir):
    return _positions(Q.latest_status(_m(spark, sf_dir)), "location", "treatment_id", "sensor_id")


@register("order_sensors", with_m("""
SELECT CAST(row_number() OVER (ORDER BY sensor_id) AS BIGINT) AS place, sensor_id
FROM (SELECT DISTINCT sensor_id FROM m) s"""))
def q_order_sensors(spark, sf_dir):
    return _positions(Q.distinct_sensors(_m(spark, sf_dir)), "sensor_id")


@register("order_options", with_m(f"""
, o AS (
SELECT DISTINCT 0 AS f, 0 AS n, location AS value FROM m
UNION ALL SELECT DISTINCT 1, sensor_id, CAST(sensor_id AS VARCHAR) FROM m WHERE location IN ('Site 3')
UNION ALL SELECT DISTINCT 2, treatment_id, CAST(treatment_id AS VARCHAR) FROM m
          WHERE location IN ('Site 3') AND sensor_id IN (5))
SELECT CAST(row_number() OVER (ORDER BY f, n, value) AS BIGINT) AS place, value FROM o"""))
def q_order_options(spark, sf_dir):
    return _positions(S.filter_options(_m(spark, sf_dir), ["Site 3"], [5]), "value")


@register("order_gaps", with_m(", " + _GAP_SQL.strip() + """
SELECT CAST(row_number() OVER (ORDER BY sensor_id, treatment_id, location) AS BIGINT) AS place,
       sensor_id, treatment_id, location FROM gaps"""))
def q_order_gaps(spark, sf_dir):
    return _positions(Q.gap_stats(_m(spark, sf_dir), START, END), "sensor_id", "treatment_id", "location")


@register("order_connectivity", with_m(", " + _conn_sql("1 DAY", *RANGE_1D).strip() + """
SELECT CAST(row_number() OVER (ORDER BY time_bin, sensor_id, location) AS BIGINT) AS place, time_bin, sensor_id, location
FROM conn"""))
def q_order_connectivity(spark, sf_dir):
    return _positions(Q.connectivity_stats(_m(spark, sf_dir), *RANGE_1D), "time_bin", "sensor_id", "location")


@register("order_alerts", with_m(", " + _GAPS_SQL.strip() + """
SELECT CAST(row_number() OVER (ORDER BY kind, pos NULLS FIRST, sensor_id, location) AS BIGINT) AS place,
       kind, pos, sensor_id, location FROM alerts""", dim=True))
def q_order_alerts(spark, sf_dir):
    return _positions(Q.sensor_gaps(_m(spark, sf_dir), E.fixture_sensors(spark), NOW),
                      "kind", "pos", "sensor_id", "location")


@register("order_series", with_m(f"""
SELECT CAST(row_number() OVER (ORDER BY encode({_LABEL}), sensor_id, window_start) AS BIGINT) AS place,
       sensor_id, window_start FROM m"""))
def q_order_series(spark, sf_dir):
    return _positions(S.temperature_series(_m(spark, sf_dir), mode="delta"), "sensor_id", "window_start")


# queries on stored aggregates, pages, alerts and interrupted runs add themselves
from fieldsense.plans import catalog_stored  # noqa: E402, F401
