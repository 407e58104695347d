"""Label, colour and text expressions (all built-in column functions)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsense.schema import (ALERT_FORMAT, COLOR_FORMAT, NO_QUALITY_COLOR, SENSOR_LABEL_FORMAT,
                               TREATMENT_LABEL_FORMAT, TREATMENT_LABELS)


def treatment_label(tid: Column, labels: dict | None = None) -> Column:
    """Configured label of a treatment, else ``Treatment <id>``."""
    labels = TREATMENT_LABELS if labels is None else labels
    default = F.format_string(TREATMENT_LABEL_FORMAT, tid.cast("string"))
    if not labels:
        return default
    lookup = F.create_map(*chain.from_iterable((F.lit(int(k)), F.lit(v)) for k, v in labels.items()))
    return F.coalesce(lookup[tid.cast("bigint")], default)


def quality_color(q: Column, max_quality: float = 1.0) -> Column:
    """``rgb(r,g,0)``: red for 0, green for 1, linear in between (clamped);
    grey when there is no value. Channels are truncated to integers."""
    ratio = F.least(F.greatest(q / F.lit(max_quality), F.lit(0.0)), F.lit(1.0))
    r = (F.lit(255) * (F.lit(1.0) - ratio)).cast("int")
    g = (F.lit(255) * ratio).cast("int")
    return (F.when(q.isNull() | F.isnan(q), F.lit(NO_QUALITY_COLOR))
            .otherwise(F.format_string(COLOR_FORMAT, r.cast("string"), g.cast("string"))))


def percent_text(ratio: Column) -> Column:
    """``95%``: ratio in percent, no decimals; the product is rounded half
    to even (``rint``), like Python's ``{:.0%}``."""
    return F.concat(F.rint(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


def fixed_text(x: Column, digits: int) -> Column:
    """Number as text with ``digits`` decimals, rounded like Python's
    ``format(x, '.nf')``: half to even on the exact binary value (Java's
    DecimalFormat, without grouping separators)."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def round_like_python(x: Column, digits: int) -> Column:
    """``round(x, digits)`` with Python's result (exact binary value, half to
    even), e.g. 0.15 -> 0.1 and 2.675 -> 2.67."""
    return fixed_text(x, digits).cast("double")


def two_digits(x: Column) -> Column:
    """Number as text with exactly two decimals (``f"{x:.2f}"``)."""
    return fixed_text(x, 2)


def sensor_option_label(sid: Column) -> Column:
    return F.format_string(SENSOR_LABEL_FORMAT, sid.cast("string"))


def alert_text(sid: Column, location: Column, hours: Column) -> Column:
    """``Sensor <id> (<location>): <hours> h without signal``."""
    return F.format_string(ALERT_FORMAT, sid.cast("string"), location, hours.cast("string"))
