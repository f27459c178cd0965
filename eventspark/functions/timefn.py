"""Time parsing, formatting, bucketing and interval arithmetic."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 instant as accepted by java.time.Instant.parse: date, 'T', time with
# seconds, up to nine fraction digits, then 'Z' or an offset; case-insensitive.
_ISO_INSTANT_RE = (r"(?i)\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?"
                   r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)\z")
ISO_OUT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

_UNIT_MICROS = {
    "second": 1_000_000, "seconds": 1_000_000,
    "minute": 60_000_000, "minutes": 60_000_000,
    "hour": 3_600_000_000, "hours": 3_600_000_000,
    "day": 86_400_000_000, "days": 86_400_000_000,
}


def interval_micros(width: str | int) -> int:
    """'10 seconds' / '15 minutes' / '24 hours' -> microseconds (ints are seconds)."""
    if isinstance(width, int):
        return width * 1_000_000
    n, unit = width.split()
    return int(n) * _UNIT_MICROS[unit.lower()]


def parse_instant(c: Column) -> Column:
    """Parse an ISO instant; NULL when the text is not one (strict shape first,
    because the plain cast also takes a bare date or a time without zone)."""
    strict = F.coalesce(c.rlike(_ISO_INSTANT_RE), F.lit(False))
    return F.when(strict, F.try_to_timestamp(F.upper(c)))


def format_instant(c: Column) -> Column:
    return F.date_format(c, ISO_OUT_FORMAT)


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, floored like ``Duration.toMillis``.

    Taken from the exact microsecond difference, never from two separately
    rounded epoch-millisecond values (that is off by one across a boundary).
    """
    d = F.unix_micros(end) - F.unix_micros(start)
    return ((d - F.pmod(d, F.lit(1000))) / F.lit(1000)).cast("long")


def nonneg_millis_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), millis_between(start, end))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds of ``end - start`` as DOUBLE (``extract(epoch FROM end - start)``)."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def time_bucket(c: Column, width: str | int) -> Column:
    """Start of the fixed-width bucket holding ``c``; buckets are aligned to the
    Unix epoch, which equals any day-aligned origin for widths dividing a day."""
    w = interval_micros(width)
    m = F.unix_micros(c)
    return F.timestamp_micros(m - F.pmod(m, F.lit(w)))


def to_micros(t) -> int:
    """Epoch microseconds of an int (taken as such), a datetime or an ISO text;
    without a zone they are UTC, whatever the machine's zone is."""
    if isinstance(t, int):
        return t
    if isinstance(t, str):
        t = _dt.datetime.fromisoformat(t)
    t = t if t.tzinfo else t.replace(tzinfo=_dt.timezone.utc)
    return (t - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)) // _dt.timedelta(microseconds=1)


def instant(t) -> Column:
    """A literal instant (see ``to_micros``)."""
    return F.timestamp_micros(F.lit(to_micros(t)).cast("long"))
