"""Working hours between two times, in the three variants the reports use.

End-point days are not checked for weekends, and a time before opening gives a
negative part; both are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.functions.time import MICROS_PER_HOUR, col, day, micros_of_day
from bizlake.operators.calendar import HOURS_HOLIDAYS, business_index

OPEN_HOUR = 9
CLOSE_HOUR = 18
HOUR = float(MICROS_PER_HOUR)


class Moment(NamedTuple):
    """A time as the formulas need it: its day, and the microseconds since midnight."""

    day: Column
    micros: Column


def moment(c: str | Column | Moment) -> Moment:
    return c if isinstance(c, Moment) else Moment(day(c), micros_of_day(c))


def with_moments(df: DataFrame, *names: str) -> tuple[DataFrame, list[Moment]]:
    """``df`` with the moments of time columns as columns of their own, so that several formulas share them.

    Inside one formula the parts of a time are written out wherever they are used; shared columns keep the generated
    code small enough to be compiled.
    """
    made = {f"_{kind}_{n}": part for n in names for kind, part in zip(Moment._fields, moment(n), strict=True)}
    return df.withColumns(made), [Moment(F.col(f"_day_{n}"), F.col(f"_micros_{n}")) for n in names]


def _full_days(t1: Column, t2: Column, holidays: Sequence[date]) -> Column:
    """Business days strictly between the two dates."""
    return business_index(F.date_sub(t2, 1), holidays) - business_index(t1, holidays)


def _parts(t1, t2, open_hour, close_hour):
    start, end = moment(t1), moment(t2)
    gap = F.datediff(end.day, start.day)
    since_open = end.micros / F.lit(HOUR) - open_hour
    until_close = F.lit(float(close_hour)) - start.micros / F.lit(HOUR)
    return start, end, gap, since_open, until_close


def _on_one_day(start: Moment, end: Moment) -> Column:
    return (end.micros - start.micros) / F.lit(HOUR)


def _hour(t: Moment) -> Column:
    return F.floor(t.micros / MICROS_PER_HOUR)


def business_hours(
    t1: str | Column | Moment,
    t2: str | Column | Moment,
    open_hour: int = OPEN_HOUR,
    close_hour: int = CLOSE_HOUR,
    hours_per_day: int = 9,
    holidays: Sequence[date] = HOURS_HOLIDAYS,
) -> Column:
    """Variant 1: elapsed on one day, else opening-to-end plus start-to-closing plus full days."""
    start, end, gap, since_open, until_close = _parts(t1, t2, open_hour, close_hour)
    in_hours = start.micros <= close_hour * MICROS_PER_HOUR
    first_day = F.when(in_hours, until_close).otherwise(F.lit(0.0))
    full = F.when(gap > 1, _full_days(start.day, end.day, holidays) * hours_per_day).otherwise(F.lit(0))
    return F.when(gap == 0, _on_one_day(start, end)).when(gap > 0, since_open + first_day + full)


def business_hours_case(t1: str | Column | Moment, t2: str | Column | Moment, close_hour: int = CLOSE_HOUR) -> Column:
    """Branch code of variant 1: 1/2 same day, 4/3 next day, 6/5 later (before/after closing)."""
    start, end = moment(t1), moment(t2)
    gap = F.datediff(end.day, start.day)
    in_hours = start.micros <= close_hour * MICROS_PER_HOUR
    return (
        F.when(gap == 0, F.when(in_hours, 1).otherwise(2))
        .when(gap == 1, F.when(in_hours, 4).otherwise(3))
        .when(gap > 1, F.when(in_hours, 6).otherwise(5))
    )


def clock_hours(
    t1: str | Column | Moment,
    t2: str | Column | Moment,
    open_hour: int = OPEN_HOUR,
    close_hour: int = CLOSE_HOUR,
    hours_per_day: int = 14,
    holidays: Sequence[date] = HOURS_HOLIDAYS,
) -> Column:
    """Variant 2, on whole clock hours: the next day counts from opening only, and no elapsed
    time on one day gives NULL."""
    start, end, gap, since_open, until_close = _parts(t1, t2, open_hour, close_hour)
    full = _full_days(start.day, end.day, holidays) * hours_per_day
    later = since_open + full + F.when(_hour(start) >= close_hour, F.lit(0.0)).otherwise(until_close)
    same = F.nullif(_on_one_day(start, end), F.lit(0.0))
    return F.when(gap == 0, same).when(gap == 1, since_open).when(gap > 1, later)


def clock_hours_case(t1: str | Column | Moment, t2: str | Column | Moment, close_hour: int = CLOSE_HOUR) -> Column:
    """Branch code of variant 2; the hour of closing counts as before closing on the first day,
    as after closing from the next day on."""
    start, end = moment(t1), moment(t2)
    gap = F.datediff(end.day, start.day)
    h = _hour(start)
    return (
        F.when(gap == 0, F.when(h <= close_hour, 1).otherwise(2))
        .when(gap == 1, F.when(h >= close_hour, 3).otherwise(4))
        .when(gap > 1, F.when(h >= close_hour, 5).otherwise(6))
    )


def first_response_hours(
    asked: str | Column,
    answered: str | Column,
    first_valid: str | Column,
    open_hour: int = OPEN_HOUR,
    close_hour: int = CLOSE_HOUR,
    hours_per_day: int = 9,
    holidays: Sequence[date] = HOURS_HOLIDAYS,
) -> Column:
    """Variant 3, over aggregated times: NULL when the first valid answer precedes the request,
    never negative on one day, and start-to-closing always counts from the second day after."""
    start, end, gap, since_open, until_close = _parts(asked, answered, open_hour, close_hour)
    in_hours = start.micros <= close_hour * MICROS_PER_HOUR
    next_day = since_open + F.when(in_hours, until_close).otherwise(F.lit(0.0))
    later = since_open + until_close + _full_days(start.day, end.day, holidays) * hours_per_day
    return (
        F.when(col(first_valid) < col(asked), F.lit(None).cast("double"))
        .when(gap == 0, F.greatest(_on_one_day(start, end), F.lit(0.0)))
        .when(gap == 1, next_day)
        .when(gap > 1, later)
    )
