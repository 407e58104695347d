"""Schemas, the logical key and fixed values of the measurement domain."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They must equal the original application's values for equal
# results; stated here together, in their natural order.
# ---------------------------------------------------------------------------
QUALITY_MIN = 0.0
QUALITY_MAX = 1.0
TREATMENT_LABELS = {1: "+1.5°C", 2: "+3°C", 3: "+4.5°C"}
HEADER_FIELDS = ("site_id", "window_start", "window_end", "n_observations", "treatments")
TREATMENT_FIELDS = ("treatment_id", "mean_control_temp", "mean_treatment_temp",
                    "received_packets", "expected_packets", "connection_quality")
UNKNOWN_LOCATION = "Unknown"          # location of a sensor missing from the config
SILENT_DEFAULT_LOCATION = "unknown"   # location of a silent configured sensor without one
DEFAULT_FREQUENCY_MINUTES = 15
DEFAULT_GAP_THRESHOLD_HOURS = 3.0
SILENCE_LOOKBACK_HOURS = 24
SILENT_SENSOR_GAP_HOURS = 24.0
PAGE_SIZE = 10
NO_QUALITY_COLOR = "rgb(128,128,128)"
# adaptive connectivity bins: (largest range, bin width)
CONNECTIVITY_BINS = ((3 * 86400, "1 hour"), (30 * 86400, "6 hours"))
CONNECTIVITY_BIN_LONG = "1 day"
# texts: rejection reasons (first failing check), labels, alert line, colours
MSG_JSON_ERROR = "JSON parse error: not a well-formed JSON document"
MSG_MISSING_FIELD = "Missing required field: %s"
MSG_INVALID_SITE = "Invalid site_id: %s"
MSG_INVALID_OBSERVATIONS = "Invalid n_observations: %s"
MSG_INVALID_DATETIME = "Invalid datetime field: %s %s"
MSG_EMPTY_TREATMENTS = "treatments must be a non-empty list"
MSG_TREATMENT_MISSING_FIELD = "Treatment missing required field: %s"
MSG_INVALID_TREATMENT_ID = "Invalid treatment_id: %s"
MSG_INVALID_TEMPERATURE = "Invalid temperature field: %s"
MSG_INVALID_PACKETS = "Invalid packets field: %s"
MSG_INVALID_QUALITY = "Invalid connection_quality field: %s"
MSG_QUALITY_RANGE = "Connection quality %s out of valid range (%s-%s)"
TREATMENT_LABEL_FORMAT = "Treatment %s"
SENSOR_LABEL_FORMAT = "Sensor %s"
SENSOR_SERIES_FORMAT = "Sensor %s (%s)"
GAP_LABEL_FORMAT = "S%s/T%s"
ALERT_FORMAT = "Sensor %s (%s): %s h without signal"
ALERT_SEPARATOR = "; "
COLOR_FORMAT = "rgb(%s,%s,0)"
DISPLAY_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ---------------------------------------------------------------------------

KEY = ("sensor_id", "treatment_id", "window_start")
PARTITION_COLUMN = "window_date"

MEASUREMENT_COLUMNS = (
    "sensor_id", "treatment_id", "location", "window_start", "window_end",
    "n_observations", "control_temp", "treatment_temp",
    "received_packets", "expected_packets", "connection_quality",
)

MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("sensor_id", T.LongType(), False),
    T.StructField("treatment_id", T.LongType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("window_start", T.TimestampNTZType(), False),
    T.StructField("window_end", T.TimestampNTZType(), False),
    T.StructField("n_observations", T.LongType(), False),
    T.StructField("control_temp", T.DoubleType(), False),
    T.StructField("treatment_temp", T.DoubleType(), False),
    T.StructField("received_packets", T.LongType(), False),
    T.StructField("expected_packets", T.LongType(), False),
    T.StructField("connection_quality", T.DoubleType(), False),
])

def empty_measurements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEASUREMENT_SCHEMA)


SENSOR_DIM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("frequency_minutes", T.IntegerType()),
    T.StructField("max_gap_hours", T.DoubleType()),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("first", T.BooleanType(), False),
])


def sensor_entries(sensors: Iterable[Mapping] | None) -> list[dict]:
    """Configuration entries with their position and a ``first`` flag for the
    first entry of each id ("first entry wins" where an id is listed twice)."""
    out, seen = [], set()
    for pos, s in enumerate(sensors or []):
        sid = int(s["id"])
        mg = s.get("max_gap_hours")
        fm = s.get("frequency_minutes")
        out.append({"id": sid, "name": s.get("name"), "location": s.get("location"),
                    "frequency_minutes": None if fm is None else int(fm),
                    "max_gap_hours": None if mg is None else float(mg),
                    "pos": pos, "first": sid not in seen})
        seen.add(sid)
    return out


def sensor_dim(spark: SparkSession, sensors: Iterable[Mapping] | None) -> DataFrame:
    """Sensor dimension from the parsed configuration (a list of mappings of
    any length). ``None`` or no file means no sensors.

    The entries enter the plan as Arrow rows, so the optimizer knows their exact
    size and Spark itself decides whether a join may broadcast them. A dimension
    that is a table already can be passed to the operators as it is.
    Columns: id, name, location, frequency_minutes, max_gap_hours, pos, first.
    """
    import pyarrow as pa
    arrow = pa.schema([("id", pa.int64()), ("name", pa.string()), ("location", pa.string()),
                       ("frequency_minutes", pa.int32()), ("max_gap_hours", pa.float64()),
                       ("pos", pa.int32()), ("first", pa.bool_())])
    rows = [{**e, "name": None if e["name"] is None else str(e["name"]),
             "location": None if e["location"] is None else str(e["location"])} for e in sensor_entries(sensors)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=arrow), SENSOR_DIM_SCHEMA)


def load_sensor_config(spark: SparkSession, path: str) -> list[dict]:
    """Read the sensor configuration (YAML, of which JSON is a part) from any
    path Spark can read; an absent file means no sensors. Needs PyYAML."""
    import yaml
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    data = yaml.safe_load("\n".join(r["value"] for r in text.collect())) or {}
    return list(data.get("sensors", []) or [])
