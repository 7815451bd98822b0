"""NULL keys and times in cut keys, zone-free durations, and the plain-text test before JSON is parsed."""

import pytest
from bizlake.functions.changes import may_hold, new_value
from bizlake.functions.time import elapsed_hours, second_of_day
from bizlake.operators.keys import first_per_key
from bizlake.operators.ordered import neighbours, next_match, running_sum
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    text = "k string, ts string, id int, v int"
    data = [(k, t, i, i) for i, (k, t) in enumerate([("a", "2024-01-01 00:10"), ("a", "2024-01-01 05:00"), ("a", None), (None, "2024-01-01 01:00"), (None, "2024-01-02 01:00"), (None, None), ("b", "2024-01-01 01:00")])]
    return spark.createDataFrame(data, text).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_cut_keys_lose_no_nulls(rows):
    for run in (
        lambda cuts: neighbours(rows, ["k"], ["ts", "id"], previous={"v": "before"}, following={"v": "after"}, sequence="n", cuts=cuts),
        lambda cuts: next_match(rows, ["k"], "ts", F.col("v") % 2 == 1, "next", cuts=cuts),
        lambda cuts: running_sum(rows, ["k"], "ts", "v", "total", cuts=cuts),
    ):
        plain, sliced = ({r["id"]: r.asDict() for r in run(cuts).collect()} for cuts in (0, 1024))
        assert len(plain) == rows.count() and plain == sliced


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "America/Sao_Paulo"])
def test_durations_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-09 18:30:00.25' AS a, TIMESTAMP_NTZ '2024-03-10 10:00:00.25' AS b")
        got = df.select(elapsed_hours("a", "b").alias("h"), second_of_day("a").alias("s")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (got["h"], got["s"]) == (15.5, 66600.25)


def test_may_hold_is_a_superset(spark):
    texts = ['{"f": ["1", "2"]}', '{"f": [1, 2]}', '{"f": [true, false]}', '{"f": [null, "a\\u0062"]}', '{"f": [null, null]}', '{"g": ["x", "y"]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("2", "false", "ab", "y"):
        exact = df.where(new_value("t", "f") == word)
        assert exact.where(may_hold("t", word)).count() == exact.count()
    assert df.where(new_value("t", "f") == "2").where(may_hold("t", "2")).count() == 2


def test_first_per_key_needs_no_sort_aggregate(spark, rows):
    first = first_per_key(rows, ["k"], ["ts"])
    assert {(r["k"], r["id"]) for r in first.collect()} == {("a", 0), (None, 3), ("b", 6)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan
