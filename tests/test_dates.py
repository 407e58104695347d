"""Free-form dates against dateutil's reading of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldsense.functions.dates import free_form_seconds
from fieldsense.functions.time import ntz_from_seconds, parse_utc

FORMATS = ["%a %b %d %Y %H:%M:%S", "%A, %B %d, %Y %I:%M %p", "%d %B %Y %H:%M", "%b %d, %Y %I:%M:%S %p", "%m/%d/%y %H:%M",
           "%d-%b-%Y %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%a, %d %b %Y %H:%M:%S +0230", "%a, %d %b %Y %H:%M:%S -0700",
           "%a, %d %b %Y %H:%M:%S GMT", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S", "%Y%m%d%H%M", "%Y/%m/%d %H:%M", "%H:%M %d %B %Y",
           "%H:%M:%S %m/%d/%Y", "%B %d, %Y at %I:%M %p", "%d of %B %Y", "%b-%d-%Y", "%Y %b %d", "%d %b %Y %I %p",
           "%d %b %y %H:%M", "%m/%d/%Y %I:%M%p", "%Y-%m-%d %I:%M:%S %p", "%d %b %Y %Hh%Mm%Ss", "%B %d %Y %H:%M:%S.25",
           "%Y.%m.%d %H:%M", "%A %d %B %Y %H:%M:%SZ", "%m-%d-%Y", "%m.%d.%Y %H:%M:%S"]


def read(spark, texts, how=free_form_seconds):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    secs = how(F.col("t"))
    out = df.select("i", (ntz_from_seconds(secs) if how is free_form_seconds else secs).alias("ts"))
    return [r.ts for r in out.orderBy("i").collect()]


def test_like_dateutil(spark):
    parser = pytest.importorskip("dateutil.parser")
    rnd, texts = random.Random(2), []
    for f in FORMATS:
        for _ in range(12):
            at = dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rnd.randrange(30 * 366 * 86400))
            t = at.strftime(f)
            lower = t if "GMT" in f or f.endswith("Z") else t.lower()          # dateutil wants zone names in capitals
            texts.append(rnd.choice([t, t.upper(), lower, f"  {t.replace(' ', '  ')} "]))
    want = []
    for t in texts:
        d = parser.parse(t)
        want.append((d.astimezone(dt.timezone.utc).replace(tzinfo=None) if d.tzinfo else d).replace(microsecond=0))
    for how in (free_form_seconds, parse_utc):
        got = read(spark, texts, how)
        assert not [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]


@pytest.mark.parametrize("text,want", [
    ("15th of January 2024", "2024-01-15 00:00:00"), ("the 15 Jan 2024", None), ("1st Feb 2024 12 am", "2024-02-01 00:00:00"),
    ("3 Sept. 2024 12:30 p.m.", "2024-09-03 12:30:00"), ("15 Jan 2024 13:00 PM", None), ("15 Jan 2024 0:10 AM", None),
    ("31 Feb 2024", None), ("Jan 15", None), ("10:30", None), ("2024", None), ("2024-01", None), ("", None), (None, None),
    ("15 Jan 2024 10:30 EST", "2024-01-15 15:30:00"), ("15 Jan 2024 10:30 UTC+3", "2024-01-15 07:30:00"),
    ("15 Jan 2024 10:30 CEST", None), ("1/2/3/4", None), ("15 Jan Feb 2024", None), ("99-01-15", "1999-01-15 00:00:00"),
    ("15 jan 68", "2068-01-15 00:00:00"), ("15 jan 69", "1969-01-15 00:00:00"), ("29 Feb 1900", None), ("a" * 100_000, None),
    ("1 " * 50_000, None), ("2024-01-15 24:00", None), ("15 Jan 2024 10:61", None)])
def test_single_texts(spark, text, want):
    got = read(spark, [text])[0]
    assert got == (dt.datetime.fromisoformat(want) if want else None)


def test_no_python_worker_and_any_session_zone(spark):
    df = spark.createDataFrame([("5 PM on Tue 3 Sept 2024",)], "t string").select(parse_utc(F.col("t")).alias("ts"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    keep = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert read(spark, ["5 PM on Tue 3 Sept 2024"], parse_utc)[0] == dt.datetime(2024, 9, 3, 17)
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)


def test_only_formats_of_a_text_s_shape_are_tried(spark):
    from fieldsense.functions.time import DATE_FORMATS, _shape
    import re
    texts = {"yyyyMMdd['T'HHmm[ss]]": ["20240102", "20240102T0304", "20240102T030405"], "d.M.yyyy[ H:m[:s]]": ["2.1.2024 3:4"],
             "MMM d yyyy[ H:m[:s]]": ["Jan 2 2024", "JAN 2 2024 03:04:05"], "d MMM yyyy[ H:m[:s]]": ["2 jan 2024 3:4"]}
    for fmt, some in texts.items():
        assert all(re.search(_shape(fmt), t) for t in some)
        assert not any(re.search(_shape(fmt), t) for t in ("Tue Jan 02 2024", "02-Jan-2024", ""))
    assert _shape("yyyy-MM-dd VV") is None and re.search(_shape("'o''clock' H"), "o'clock 3")
    frame = spark.createDataFrame([("x",)], "t string")
    plan = frame.select(parse_utc(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") >= 2 + len(DATE_FORMATS)
