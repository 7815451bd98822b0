"""Time arithmetic with PostgreSQL meaning on zone-less UTC timestamps."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "America/Sao_Paulo"
MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR
WEEK_MONDAY = date(1970, 1, 5)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_ts(as_of: datetime | str | None) -> Column:
    """The report time as a zone-less timestamp; the current time when not given."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def ts_lit(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@cache
def settled_offset(zone: str) -> tuple[datetime, timedelta] | None:
    """Since when (UTC) a zone has kept one offset from UTC, and that offset; None if it still changes clocks.

    The offset is looked at every week up to 2100; a change is taken to lie in the week before the first different one.
    """
    at, week = datetime(2100, 1, 1, tzinfo=timezone.utc), timedelta(days=7)
    offset = at.astimezone(ZoneInfo(zone)).utcoffset()
    while at.year >= 1970 and at.astimezone(ZoneInfo(zone)).utcoffset() == offset:
        at -= week
    since = (at + week).replace(tzinfo=None)
    return (since, offset) if since.year < 2090 else None


def _shifted(c: Column, offset: timedelta) -> Column:
    return c + F.make_dt_interval(secs=F.lit(int(offset.total_seconds())))


def local_ts(c: str | Column, zone: str = DEFAULT_ZONE, mode: str = "utc_to_local") -> Column:
    """UTC to local wall time; ``assume_local`` reads the value as local and returns UTC.

    Since a zone keeps one offset, times are shifted by it; the zone's rules, which cost many times as much, are asked for
    earlier times only.
    """
    if mode not in ("utc_to_local", "assume_local"):
        raise ValueError(f"unknown mode {mode!r}")
    utc, here, c = F.lit("UTC"), F.lit(zone), col(c).cast("timestamp_ntz")
    back = mode == "assume_local"
    by_rule = F.convert_timezone(here, utc, c) if back else F.convert_timezone(utc, here, c)
    settled = settled_offset(zone)
    if settled is None:
        return by_rule
    since, offset = settled
    if back:  # the wall times of the first days could belong to either offset
        since, offset = since + timedelta(days=2), -offset
    return F.when(c >= ts_lit(str(since)), _shifted(c, offset)).otherwise(by_rule)


def micros_of_day(c: str | Column) -> Column:
    """Microseconds since midnight of the wall time, whatever the session's zone.

    The time since midnight as an interval, counted in millionths: an interval gives whole seconds only.
    """
    c = col(c).cast("timestamp_ntz")
    since = c - c.cast("date").cast("timestamp_ntz")
    return (since * F.lit(1_000_000)).cast("interval second").cast("bigint")


def micros(c: str | Column) -> Column:
    """Microseconds of the wall time since 1970, whatever the session's zone."""
    c = col(c).cast("timestamp_ntz")
    return F.unix_date(c.cast("date")).cast("bigint") * MICROS_PER_DAY + micros_of_day(c)


def elapsed_hours(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def elapsed_days(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_DAY))


def second_of_day(c: str | Column) -> Column:
    """Fractional seconds since midnight, for comparisons with a time of day."""
    return micros_of_day(c) / F.lit(1_000_000.0)


def day(c: str | Column) -> Column:
    return col(c).cast("date")


def day_start(c: str | Column) -> Column:
    return day(c).cast("timestamp_ntz")


def month_start(c: str | Column) -> Column:
    return F.trunc(day(c), "month")


def week_start(c: str | Column) -> Column:
    """Monday of the week."""
    return F.date_sub(day(c), F.weekday(day(c)))


def dow_sunday0(c: str | Column) -> Column:
    return F.dayofweek(day(c)) - 1


def iso_week_text(c: str | Column) -> Column:
    return F.lpad(F.weekofyear(day(c)).cast("string"), 2, "0")


def week_label(c: str | Column) -> Column:
    """'Semana IW - DD/MM/YYYY' of the week's Monday."""
    monday = week_start(c)
    return F.concat(F.lit("Semana "), iso_week_text(monday), F.lit(" - "), fmt(monday, "dd/MM/yyyy"))


def fmt(c: str | Column, pattern: str) -> Column:
    return F.date_format(col(c), pattern)


def quarter_index(c: str | Column) -> Column:
    """Quarters on one running axis, so that offsets are plain differences."""
    return F.year(day(c)) * 4 + F.quarter(day(c)) - 1


def quarter_label(index: str | Column) -> Column:
    i = col(index)
    return F.concat(
        F.floor(i / 4).cast("int").cast("string"), F.lit(" Q"), (F.pmod(i, F.lit(4)) + 1).cast("string")
    )


def in_zone_range(
    c: str | Column, start: str | None = None, end: str | None = None, zone: str = DEFAULT_ZONE
) -> Column:
    """Local-time range test written on the stored UTC column, so file statistics can prune.

    ``start`` and ``end`` (exclusive) are local wall times.
    """
    def bound(text: str) -> Column:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts_lit(text))

    test = F.lit(True)
    if start is not None:
        test = test & (col(c) >= bound(start))
    if end is not None:
        test = test & (col(c) < bound(end))
    return test
