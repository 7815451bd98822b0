"""Hand-computed working hours. 2024-05-30 (Thursday) is closed; 2024-05-27 is a Monday."""

from datetime import datetime

import pytest

from pyspark.sql import functions as F

from bizlake.operators import hours as H


def ts(text):
    return datetime.fromisoformat(text)


V1 = [
    ("2024-05-27 10:00:00", "2024-05-27 12:30:00", 1, 2.5),
    ("2024-05-27 18:00:00", "2024-05-27 19:00:00", 1, 1.0),
    ("2024-05-27 18:00:01", "2024-05-27 19:00:01", 2, 1.0),
    ("2024-05-27 19:00:00", "2024-05-28 10:00:00", 3, 1.0),
    ("2024-05-27 17:00:00", "2024-05-28 10:00:00", 4, 2.0),
    ("2024-05-27 18:00:00", "2024-05-28 08:00:00", 4, -1.0),
    ("2024-05-27 19:00:00", "2024-05-31 10:00:00", 5, 19.0),  # two open days between, one closed
    ("2024-05-27 17:00:00", "2024-05-31 10:00:00", 6, 20.0),
    ("2024-05-24 17:00:00", "2024-05-27 10:00:00", 6, 2.0),  # only the weekend between
    ("2024-05-25 12:00:00", "2024-05-27 10:00:00", 6, 7.0),  # starts on a Saturday: not checked
    ("2024-05-27 10:00:00", "2024-05-27 10:00:00", 1, 0.0),
]
V2 = [
    ("2024-05-27 10:00:00", "2024-05-27 12:30:00", 1, 2.5),
    ("2024-05-27 10:00:00", "2024-05-27 10:00:00", 1, None),
    ("2024-05-27 18:30:00", "2024-05-27 19:00:00", 1, 0.5),
    ("2024-05-27 19:30:00", "2024-05-27 20:00:00", 2, 0.5),
    ("2024-05-27 18:00:00", "2024-05-28 10:00:00", 3, 1.0),
    ("2024-05-27 17:00:00", "2024-05-28 10:00:00", 4, 1.0),
    ("2024-05-27 18:30:00", "2024-05-31 10:00:00", 5, 29.0),
    ("2024-05-27 17:00:00", "2024-05-31 10:00:00", 6, 30.0),
]
V3 = [
    # asked, answered, first valid answer, hours
    ("2024-05-27 10:00:00", "2024-05-27 12:00:00", "2024-05-27 12:00:00", 2.0),
    ("2024-05-27 10:00:00", "2024-05-27 09:00:00", "2024-05-27 12:00:00", 0.0),
    ("2024-05-27 10:00:00", "2024-05-27 09:00:00", "2024-05-27 09:30:00", None),
    ("2024-05-27 19:00:00", "2024-05-28 10:00:00", "2024-05-28 10:00:00", 1.0),
    ("2024-05-27 17:00:00", "2024-05-28 10:00:00", "2024-05-28 10:00:00", 2.0),
    ("2024-05-27 19:00:00", "2024-05-31 10:00:00", "2024-05-31 10:00:00", 18.0),
    ("2024-05-27 17:00:00", "2024-05-31 10:00:00", None, 20.0),
    ("2024-05-27 17:00:00", "2024-05-26 10:00:00", None, None),
]


@pytest.mark.parametrize("rows, code, hours", [(V1, H.business_hours_case, H.business_hours), (V2, H.clock_hours_case, H.clock_hours)])
def test_variants(spark, rows, code, hours):
    df = spark.createDataFrame([(i, ts(a), ts(b)) for i, (a, b, _, _) in enumerate(rows)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = {r.i: (r.c, r.h) for r in df.select("i", code("a", "b").alias("c"), hours("a", "b").alias("h")).collect()}
    for i, (a, b, want_code, want) in enumerate(rows):
        assert got[i][0] == want_code, (a, b)
        assert got[i][1] == (None if want is None else pytest.approx(want)), (a, b)


def test_first_response(spark):
    rows = [(i, ts(a), ts(b), ts(v) if v else None) for i, (a, b, v, _) in enumerate(V3)]
    df = spark.createDataFrame(rows, "i int, a timestamp_ntz, b timestamp_ntz, v timestamp_ntz")
    got = {r.i: r.h for r in df.select("i", H.first_response_hours("a", "b", "v").alias("h")).collect()}
    for i, row in enumerate(V3):
        assert got[i] == (None if row[3] is None else pytest.approx(row[3])), row


def test_local_times_follow_the_zone_rules(spark):
    from bizlake.functions import time as TM

    days = spark.range(0, 3 * 45_000).select((F.lit("1980-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") * 3).cast("int"))).alias("t"))
    for zone in ("America/Sao_Paulo", "America/New_York", "Asia/Kolkata", "UTC"):
        utc, here = F.lit("UTC"), F.lit(zone)
        got = days.select("t", TM.local_ts("t", zone).alias("a"), TM.local_ts("t", zone, "assume_local").alias("b"), F.convert_timezone(utc, here, "t").alias("x"), F.convert_timezone(here, utc, "t").alias("y"))
        assert got.where("NOT (a <=> x AND b <=> y)").count() == 0
    assert TM.settled_offset("America/Sao_Paulo") is not None and TM.settled_offset("America/New_York") is None


def test_micros_are_exact(spark):
    from bizlake.functions import time as TM

    texts = ["1969-12-31 23:59:59.999999", "0001-01-01 00:00:00.000001", "2024-02-29 18:00:00.250001", "9999-12-31 23:59:59.999999"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", F.col("x").cast("timestamp_ntz").alias("t"))
    for r in rows.select("t", TM.micros("t").alias("m"), TM.micros_of_day("t").alias("d")).collect():
        since = r.t - datetime(1970, 1, 1)
        assert r.m == (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds and r.d == r.m % 86_400_000_000
