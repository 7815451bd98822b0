"""Business days as arithmetic, in both directions: no day table, no join, no limit on the range of dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.functions.time import WEEK_MONDAY, col, day, second_of_day

# Closing days used for the service-level dates.
SLA_HOLIDAYS = (
    date(2024, 1, 1), date(2024, 1, 2), date(2024, 2, 12), date(2024, 2, 13), date(2024, 3, 29), date(2024, 4, 21),
    date(2024, 5, 1), date(2024, 5, 30), date(2024, 9, 7), date(2024, 10, 12), date(2024, 11, 2), date(2024, 11, 15),
    date(2024, 12, 24), date(2024, 12, 25), date(2024, 12, 30), date(2024, 12, 31), date(2025, 1, 1), date(2025, 1, 2),
    date(2025, 1, 3), date(2025, 3, 3), date(2025, 3, 4), date(2025, 4, 18), date(2025, 4, 21), date(2025, 5, 1),
    date(2025, 6, 19), date(2025, 9, 7), date(2025, 10, 12), date(2025, 11, 2), date(2025, 11, 15), date(2025, 12, 24),
    date(2025, 12, 25), date(2025, 12, 30), date(2025, 12, 31),
)
# Closing days used for working-hours durations.
HOURS_HOLIDAYS = (
    date(2024, 1, 1), date(2024, 2, 12), date(2024, 2, 13), date(2024, 3, 29), date(2024, 4, 21), date(2024, 5, 1),
    date(2024, 5, 30), date(2024, 9, 7), date(2024, 10, 12), date(2024, 11, 2), date(2024, 11, 15), date(2024, 12, 25),
    date(2025, 1, 1), date(2025, 3, 3), date(2025, 3, 4), date(2025, 4, 18), date(2025, 4, 21), date(2025, 5, 1),
    date(2025, 6, 19), date(2025, 9, 7), date(2025, 10, 12), date(2025, 11, 2), date(2025, 11, 15), date(2025, 12, 25),
)
# First and last day of the service-level calendar.
SLA_START = date(2023, 1, 1)
SLA_END = date(2025, 12, 31)

# A calendar as a table is small enough to join anywhere (200 years); the arithmetic has no such limit.
MAX_CALENDAR_DAYS = 73_050


def _weekday_holidays(holidays: Sequence[date]) -> list[date]:
    return sorted({h for h in holidays if h.weekday() < 5})


def business_index(d: str | Column, holidays: Sequence[date]) -> Column:
    """Running number of business days up to and including ``d``.

    Weekdays come from a closed formula; closing days from a short literal array with
    one running count per day of the holiday list's span. A difference of two indexes
    counts business days with no join, at any date.
    """
    c = day(d)
    n = F.datediff(c, F.lit(WEEK_MONDAY)) + 1
    index = F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    closed = _weekday_holidays(holidays)
    if closed:
        span = (closed[-1] - closed[0]).days + 1
        counts, seen = [0], set(closed)
        for offset in range(span):
            counts.append(counts[-1] + (closed[0] + timedelta(days=offset) in seen))
        first = (closed[0] - WEEK_MONDAY).days
        at = F.least(F.greatest(n - first, F.lit(0)), F.lit(span))
        # The text is parsed once, when the plan is optimised.
        index = index - F.get(F.from_json(F.lit(str(counts)), "array<int>"), at)
    return index.cast("int")


def business_day(index: str | Column, holidays: Sequence[date]) -> Column:
    """The business day with a running number: the inverse of ``business_index``.

    Of the closing days in their order, the i-th has ``weekdays up to it - i`` business days before it. Those with fewer than the
    number searched lie before the day; with them added, the number counts plain weekdays, of which five make a week. How
    many those are is looked up in one running count per business day of the list's span.
    """
    number = col(index).cast("bigint")
    before = [_index_of(h, ()) - i for i, h in enumerate(_weekday_holidays(holidays), 1)]
    if before:
        counts, passed = [], 0
        for n in range(before[0], before[-1] + 2):
            while passed < len(before) and before[passed] < n:
                passed += 1
            counts.append(passed)
        at = F.least(F.greatest(number - before[0], F.lit(0)), F.lit(len(counts) - 1)).cast("int")
        # The text is parsed once, when the plan is optimised.
        number = number + F.get(F.from_json(F.lit(str(counts)), "array<int>"), at)
    weeks = F.floor((number - 1) / 5)
    return F.date_add(F.lit(WEEK_MONDAY), (weeks * 2 + number - 1).cast("int"))


def _index_of(d: date, holidays: Sequence[date]) -> int:
    """The same number for one known day."""
    n = (d - WEEK_MONDAY).days + 1
    return n // 7 * 5 + min(n % 7, 5) - sum(h <= d for h in _weekday_holidays(holidays))


def is_business_day(d: str | Column, holidays: Sequence[date]) -> Column:
    return business_index(d, holidays) > business_index(F.date_sub(day(d), 1), holidays)


def business_days_between(
    a: str | Column,
    b: str | Column,
    holidays: Sequence[date] = SLA_HOLIDAYS,
    start: date | None = SLA_START,
    end: date | None = SLA_END,
) -> Column:
    """Business days from ``a`` to ``b``, both ends included; 0 when ``b`` is NULL or earlier.

    ``start`` and ``end`` limit the calendar: days outside it never count.
    """
    upto, before = business_index(b, holidays), business_index(F.date_sub(day(a), 1), holidays)
    if end is not None:
        upto = F.least(upto, F.lit(_index_of(end, holidays)))
    if start is not None:
        before = F.greatest(before, F.lit(_index_of(start - timedelta(days=1), holidays)))
    known = day(a).isNotNull() & day(b).isNotNull()
    return F.when(known, F.greatest(upto - before, F.lit(0))).otherwise(F.lit(0))


def business_calendar(
    spark: SparkSession, start: date, end: date, holidays: Sequence[date] = SLA_HOLIDAYS
) -> DataFrame:
    """One row per day: ``day``, ``is_bd``, and ``bd_idx`` counted from the first day."""
    if (end - start).days >= MAX_CALENDAR_DAYS:
        raise ValueError("calendar too long for a table")
    days = spark.range((end - start).days + 1).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("day")
    )
    before = _index_of(start - timedelta(days=1), holidays)
    indexed = days.select("day", (business_index("day", holidays) - before).alias("bd_idx"))
    return indexed.select("day", is_business_day("day", holidays).alias("is_bd"), "bd_idx")


def _within(index: Column, holidays: Sequence[date], start: date | None, end: date | None) -> Column:
    """The business day with a running number, NULL outside the calendar."""
    inside = index.isNotNull()
    if start is not None:
        inside = inside & (index > _index_of(start - timedelta(days=1), holidays))
    if end is not None:
        inside = inside & (index <= _index_of(end, holidays))
    return F.when(inside, business_day(index, holidays))


def next_business_day(
    df: DataFrame,
    c: str,
    out: str,
    holidays: Sequence[date] = SLA_HOLIDAYS,
    start: date | None = SLA_START,
    end: date | None = SLA_END,
) -> DataFrame:
    """First business day on or after a date; the calendar's first one before its start, NULL past its end.

    Without ``start`` or ``end`` the calendar has no such limit.
    """
    before = business_index(F.date_sub(day(c), 1), holidays)
    if start is not None:
        before = F.greatest(before, F.lit(_index_of(start - timedelta(days=1), holidays)))
    # A column of its own, so that the index is computed once a row.
    rows = df.withColumn("_index", F.when(day(c).isNotNull(), before + 1))
    return rows.withColumn(out, _within(F.col("_index"), holidays, start, end)).drop("_index")


def sla_due_date(
    df: DataFrame,
    created: str,
    n_days: str | Column,
    out: str,
    cutoff_hour: int = 18,
    holidays: Sequence[date] = SLA_HOLIDAYS,
    start: date | None = SLA_START,
    end: date | None = SLA_END,
) -> DataFrame:
    """The N-th business day after the last business day on or before the creation date.

    Creation at or after the cut-off counts as the next day. NULL when the calendar has
    no business day on or before that date, or when it ends too early. Without ``start`` or
    ``end`` the calendar has no such limit.
    """
    late = second_of_day(created) >= cutoff_hour * 3600
    since = F.date_add(day(created), F.when(late, 1).otherwise(0))
    base = business_index(since, holidays)
    if end is not None:
        base = F.least(base, F.when(since.isNotNull(), F.lit(_index_of(end, holidays))))
    # Columns of their own, so that each index is computed once a row.
    rows = df.withColumn("_base", base)
    index = F.col("_base") + col(n_days)
    if start is not None:
        index = F.when(F.col("_base") > _index_of(start - timedelta(days=1), holidays), index)
    return rows.withColumn("_index", index).withColumn(out, _within(F.col("_index"), holidays, start, end)).drop("_base", "_index")


def plan_sla_days(plan: str | Column, kind: str | Column) -> Column:
    """Promised business days: orders from the app depend on the plan, all others take 3."""
    name = F.lower(col(plan))
    by_plan = F.when(name.like("%enterprise%"), 1).when(name.like("%pró%"), 2).otherwise(3)
    return F.when(col(kind) == "App", by_plan).otherwise(F.lit(3))
