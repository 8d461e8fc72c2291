"""Timestamp column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from geohotspots.config import LOCAL_TZ
from geohotspots.functions.text import null_if_token

# A UTC offset counts only after a clock part, or the day of a bare date would look
# like an offset.
_ZONED = (
    r"^\d{4}-.*\d{1,2}:\d{2}.*"
    r"(Z|[+-]\d{2}(:?\d{2})?(:?\d{2})?| ?(UTC|GMT)| [A-Z][A-Za-z_]+/[A-Z][A-Za-z_/]+)$"
)
_LOCAL = r"^\d{4}-\d{1,2}(-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d*)?)?)?)?)?$"

#: Further layouts, tried in this order. Where a day and a month can be swapped the day is
#: first; a month first is read only if the other way gives no date.
TIMESTAMP_FORMATS = (
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "yyyy/M/d",
    "d-M-yyyy H:mm:ss",
    "d-M-yyyy H:mm",
    "d-M-yyyy",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "MMM d yyyy H:mm:ss",
    "MMM d yyyy H:mm",
    "d MMM yyyy H:mm:ss",
    "d MMM yyyy H:mm",
    "yyyyMMdd HHmmss",
    "yyyyMMdd",
)


def parse_instant(
    c: Column, tz: str = LOCAL_TZ, formats: Sequence[str] = TIMESTAMP_FORMATS
) -> Column:
    """Text to instant, null when unparseable.

    A text with an offset or a zone name keeps its instant; one without is wall-clock time
    in ``tz``; a bare date is local midnight. Texts in no ISO form are read by the first of
    ``formats`` that fits, as wall-clock time.
    """
    return parse_trimmed_instant(null_if_token(c), tz, formats)


def parse_trimmed_instant(
    text: Column, tz: str = LOCAL_TZ, formats: Sequence[str] = TIMESTAMP_FORMATS
) -> Column:
    """As :func:`parse_instant`, for text that is trimmed and free of null tokens."""
    wall = text.try_cast("timestamp_ntz")
    parsed = F.when(text.rlike(_ZONED), text.try_cast("timestamp")).when(
        text.rlike(_LOCAL), instant_of_wall_clock(wall, tz)
    )
    if not formats:
        return parsed
    tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    other = ~text.rlike(_ZONED) & ~text.rlike(_LOCAL)
    return parsed.when(other, instant_of_wall_clock(tried.cast("timestamp_ntz"), tz))


def wall_clock(instant: Column, tz: str = LOCAL_TZ) -> Column:
    """Instant to ``TIMESTAMP_NTZ`` wall-clock time in ``tz``."""
    return F.convert_timezone(
        F.current_timezone(), F.lit(tz), instant.cast("timestamp_ntz")
    )


def instant_of_wall_clock(wall: Column, tz: str = LOCAL_TZ) -> Column:
    """``TIMESTAMP_NTZ`` wall-clock time in ``tz`` to instant."""
    return F.convert_timezone(F.lit(tz), F.current_timezone(), wall).cast("timestamp")
