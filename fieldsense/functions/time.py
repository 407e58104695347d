"""Time expressions. Tables keep UTC wall clock as TIMESTAMP_NTZ, so nothing
here depends on the session time zone."""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsense.functions.dates import free_form_seconds
from fieldsense.schema import CONNECTIVITY_BIN_LONG, CONNECTIVITY_BINS


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

_ISO_RE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$"
# a zone after the time of day: Z, +hh, +hhmm, +hh:mm or a region id (UTC, CET, Europe/Berlin)
_ZONE = r"(z|[+-][0-9]{2}(:?[0-9]{2})?|[a-z][a-z0-9_+-]*(/[a-z0-9_+-]+)*)$"
_ZONE_RE = r"(?i)[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*" + _ZONE
# further forms, tried in this order where the text is no ISO form (patterns of Spark's
# to_timestamp); day and month by numbers: the month comes first where both readings are possible
DATE_FORMATS = ("yyyyMMdd['T'HHmm[ss]]", "yyyy/M/d[ H:m[:s]]", "M.d.yyyy[ H:m[:s]]", "d.M.yyyy[ H:m[:s]]",
                "M/d/yyyy[ H:m[:s]]", "d/M/yyyy[ H:m[:s]]", "MMM d yyyy[ H:m[:s]]", "d MMM yyyy[ H:m[:s]]")


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from ``datetime`` or ``'yyyy-MM-dd HH:mm:ss'``.

    Folded to a constant by Catalyst, so predicates on it reach the scan.
    """
    text = to_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def to_datetime(value) -> _dt.datetime:
    """A naive UTC ``datetime`` from a datetime, date or ISO text (naive
    input is UTC; an offset is converted to UTC)."""
    if isinstance(value, _dt.datetime):
        d = value
    elif isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    else:
        d = _dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00").replace("z", "+00:00"))
    if d.tzinfo is not None:
        d = d.astimezone(_dt.timezone.utc)
    return d.replace(tzinfo=None)


def ntz_from_seconds(secs: Column) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) for epoch seconds (NTZ arithmetic,
    independent of the session time zone)."""
    return F.timestamp_add("SECOND", secs, _epoch_ntz())


def epoch_seconds_ntz(ts: Column) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ wall clock, fractions dropped.

    Built from the wall date and time of day, so no time zone enters
    (``timestamp_diff`` would first cast to a session-zone TIMESTAMP).
    """
    return (F.unix_date(ts.cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def _shape(fmt: str) -> str | None:
    """A regular expression that every text of the pattern ``fmt`` matches (others
    may, too); None where the pattern has letters beyond date and time of day."""
    out = []
    for quoted, run, other in re.findall(r"'((?:[^']|'')*)'|([A-Za-z]+)|(.)", fmt, re.S):
        if run:
            for letters in re.findall(r"y+|M+|d+|H+|h+|m+|s+|S+|E+|a+|.", run):
                if letters[0] not in "yMdHhmsSEa":
                    return None
                named = letters[0] in "Ea" or (letters[0] == "M" and len(letters) > 2)
                piece = r"[^0-9\s]+" if named else "[+0-9-]+"
                if not out or out[-1] != piece:            # numbers side by side are one run of digits
                    out.append(piece)
        else:
            out.append({"[": "(?:", "]": ")?"}.get(other) or _escaped(quoted.replace("''", "'") or other or "'"))
    return "(?is)^" + "".join(out) + "$"


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def parse_utc(text: Column, formats: Sequence[str] = DATE_FORMATS, free_form: bool = True) -> Column:
    """Date/time text to UTC TIMESTAMP_NTZ truncated to whole seconds.

    ISO forms are read first: ``yyyy-MM-dd``, ``yyyy-MM-dd HH:mm[:ss[.f]]`` with
    ``T`` or a space, optionally followed by ``Z``, an offset or a region id
    (converted to UTC; without a zone the text is UTC). Other texts are tried
    with ``formats`` in order, as UTC, and then, with ``free_form``, read by their
    tokens (``free_form_seconds``). A text without year, month or day, and
    anything else, gives NULL.
    """
    s = F.regexp_replace(F.trim(text), r"([0-9])z$", "$1Z")
    # the cast wants seconds before a region id
    s = F.regexp_replace(s, r"(?i)([T ][0-9]{1,2}:[0-9]{2})\s+(?=[a-z][a-z0-9_+-]*(/[a-z0-9_+-]+)*$)", "$1:00 ")
    iso, zoned = s.rlike(_ISO_RE), s.rlike(_ZONE_RE)
    secs = (F.when(iso & zoned, F.unix_seconds(s.try_cast("timestamp")))
            .when(iso, epoch_seconds_ntz(s.try_cast("timestamp_ntz"))))
    if formats:
        loose = F.regexp_replace(s, ",", "")
        # a fixed offset is added to text and pattern: the session time zone plays no part
        # a text that fails a format costs an exception, so only those of its shape are tried
        tried = []
        for f in formats:
            read = F.unix_seconds(F.try_to_timestamp(F.concat(loose, F.lit(" +0000")), F.lit(f + " xx")).cast("timestamp"))
            shape = _shape(f)
            tried.append(read if shape is None else F.when(loose.rlike(shape), read))
        secs = F.when(iso, secs).otherwise(F.coalesce(*tried))
    if free_form:
        secs = F.coalesce(secs, free_form_seconds(text))
    return ntz_from_seconds(secs)


def time_floor(ts: Column, width: str) -> Column:
    """Floor to a bin of ``width`` ('15 minutes', '1 hour', '6 hours', '1 day'),
    aligned to the epoch, NTZ in and out, no time zone involved; NULL stays NULL."""
    amount, unit = width.split()
    step = int(amount) * _UNIT_SECONDS[unit.rstrip("s")]
    secs = epoch_seconds_ntz(ts)
    return ntz_from_seconds(secs - F.pmod(secs, F.lit(step)))


def connectivity_bin(start, end) -> str:
    """Adaptive bin width: 1 h up to 3 days, 6 h up to 30 days, else 1 day."""
    seconds = (to_datetime(end) - to_datetime(start)).total_seconds()
    for limit, width in CONNECTIVITY_BINS:
        if seconds <= limit:
            return width
    return CONNECTIVITY_BIN_LONG


def expected_windows(start, end, freq: int | _dt.timedelta = 15) -> int:
    """Whole ``freq`` steps (minutes or a duration) between ``start`` and
    ``end`` plus one (truncated)."""
    step = freq if isinstance(freq, _dt.timedelta) else _dt.timedelta(minutes=freq)
    return int((to_datetime(end) - to_datetime(start)) / step) + 1


def whole_second(value) -> _dt.datetime:
    """``value`` cut to the second."""
    return to_datetime(value).replace(microsecond=0)


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from ``a`` to ``b`` (both TIMESTAMP_NTZ), exact."""
    def micros(ts: Column) -> Column:
        return epoch_seconds_ntz(ts) * 1000000 + F.pmod(F.extract(F.lit("SECOND"), ts) * 1000000, F.lit(1000000)).cast("bigint")
    return micros(b) - micros(a)


def day_bounds(start_date=None, end_date=None, today=None) -> tuple[str, str]:
    """Widen a date selection to whole days: 00:00:00 and 23:59:59.

    A missing bound means ``today`` (a required parameter then).
    """
    def day(v):
        if v is None:
            if today is None:
                raise ValueError("today is required when a bound is missing")
            v = today
        d = to_datetime(v)
        return _dt.datetime(d.year, d.month, d.day)
    lo = day(start_date)
    hi = day(end_date) + _dt.timedelta(days=1) - _dt.timedelta(seconds=1)
    return lo.strftime("%Y-%m-%d %H:%M:%S"), hi.strftime("%Y-%m-%d %H:%M:%S")
