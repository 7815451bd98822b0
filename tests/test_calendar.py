from datetime import date, datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bizlake.operators import calendar as C

DAYS = [date(2022, 12, 1) + timedelta(days=i) for i in range(1200)]


def is_open(d, holidays):
    return d.weekday() < 5 and d not in holidays


def test_index_counts_like_a_loop(spark):
    df = spark.createDataFrame([(d,) for d in DAYS], "d date")
    got = {r.d: r for r in df.select("d", C.business_index("d", C.SLA_HOLIDAYS).alias("i"), C.is_business_day("d", C.SLA_HOLIDAYS).alias("b")).collect()}
    for yesterday, today in zip(DAYS, DAYS[1:]):
        opened = is_open(today, C.SLA_HOLIDAYS)
        assert got[today].b == opened
        assert got[today].i - got[yesterday].i == opened


def test_days_between_counts_like_a_loop(spark):
    pairs = [(a, b) for a in DAYS[::37] for b in DAYS[::41]] + [(date(2019, 5, 1), date(2030, 1, 1)), (date(2026, 3, 1), date(2026, 4, 1))]
    df = spark.createDataFrame([*pairs, (DAYS[5], None), (None, DAYS[5])], "a date, b date")
    for r in df.select("a", "b", C.business_days_between("a", "b").alias("n")).collect():
        want = 0
        if r.a and r.b:
            d = max(r.a, C.SLA_START)
            while d <= min(r.b, C.SLA_END):
                want += is_open(d, C.SLA_HOLIDAYS)
                d += timedelta(days=1)
        assert r.n == want, r


def brute_due(t, n):
    d = t.date() + timedelta(days=t.hour >= 18)
    work = [x for x in (C.SLA_START + timedelta(days=i) for i in range((C.SLA_END - C.SLA_START).days + 1)) if is_open(x, C.SLA_HOLIDAYS)]
    base = [x for x in work if x <= d]
    later = [x for x in work if base and x > base[-1]]
    return later[n - 1] if len(later) >= n else None


def test_due_date_edges(spark):
    times = [
        datetime(2024, 5, 29, 17, 59, 59), datetime(2024, 5, 29, 18, 0, 0), datetime(2024, 5, 31, 18, 0, 1), datetime(2024, 12, 23, 20, 0),
        datetime(2023, 1, 1, 3, 0), datetime(2022, 12, 31, 19, 0), datetime(2022, 12, 20, 9, 0), datetime(2025, 12, 29, 9, 0),
        datetime(2025, 12, 28, 9, 0), datetime(2025, 12, 26, 17, 0), datetime(2026, 5, 1, 9, 0), datetime(2023, 1, 1, 18, 0),
    ]
    df = spark.createDataFrame([(t, n) for t in times for n in (1, 2, 3)], "t timestamp_ntz, n int")
    for r in C.sla_due_date(df, "t", "n", "due").collect():
        assert r.due == brute_due(r.t, r.n), r


def test_next_business_day(spark):
    df = spark.createDataFrame([(d,) for d in DAYS] + [(date(2026, 2, 1),), (date(2020, 2, 1),), (None,)], "d date")
    for r in C.next_business_day(df, "d", "nxt").collect():
        want = None
        if r.d:
            d = max(r.d, C.SLA_START)
            while d <= C.SLA_END and not is_open(d, C.SLA_HOLIDAYS):
                d += timedelta(days=1)
            want = d if d <= C.SLA_END else None
        assert r.nxt == want, r


@settings(max_examples=10, deadline=None)
@given(st.lists(st.dates(date(2024, 1, 1), date(2024, 12, 31)), max_size=8))
def test_any_holiday_list(spark, holidays):
    df = spark.createDataFrame([(d,) for d in DAYS[::11]], "d date")
    rows = df.select("d", C.business_index("d", holidays).alias("i")).collect()
    base = C.business_index(F.lit(DAYS[0]), holidays)
    zero = df.select(base.alias("z")).first().z
    for r in rows:
        want = sum(is_open(d, holidays) for d in DAYS if DAYS[0] < d <= r.d)
        assert r.i - zero == want


def test_long_calendar_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        C.business_calendar(spark, date(1900, 1, 1), date(2200, 1, 1))


def test_business_day_inverts_the_index_at_any_date(spark):
    days = spark.range(200_000).select(F.date_add(F.lit(date(1800, 1, 1)), F.col("id").cast("int")).alias("d"))
    for holidays in ((), C.SLA_HOLIDAYS, C.HOURS_HOLIDAYS, (date(1900, 1, 1), date(2300, 12, 31), date(2024, 1, 1))):
        found = days.where(C.is_business_day("d", holidays)).select("d", C.business_day(C.business_index("d", holidays), holidays).alias("e"))
        assert found.where("d <> e OR e IS NULL").count() == 0
    assert spark.range(1).select(C.business_day(F.lit(None).cast("int"), C.SLA_HOLIDAYS)).first()[0] is None


def test_due_dates_without_a_calendar_end(spark):
    df = spark.createDataFrame([("2031-05-02 19:00:00", 3), ("1990-01-06 08:00:00", 1), (None, 1)], "t string, n int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = C.sla_due_date(df, "t", F.col("n"), "due", start=None, end=None)
    assert [str(r.due) for r in got.collect()] == ["2031-05-07", "1990-01-08", "None"]
    late = C.next_business_day(df, "t", "d", start=None, end=None)
    assert [str(r.d) for r in late.collect()] == ["2031-05-02", "1990-01-08", "None"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
