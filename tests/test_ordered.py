"""Scans over cut keys give what one plain window over whole keys gives, whatever the number of cut points."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bizlake.operators import keys as K
from bizlake.operators import ordered as O
from bizlake.operators import pairs as P
from bizlake.operators import ranges as R
from bizlake.operators import skew as S
from bizlake.operators import status as T

START = datetime(2024, 1, 1)
SCHEMA = "i int, k string, at timestamp_ntz, s string, v int"


def made(kind):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if kind != "many" or rng.random() < 0.4 else rng.choice([None, *(f"k{j}" for j in range(40))])
        at = START if kind == "instant" else START + timedelta(minutes=rng.randrange(60 * 24 * 6))
        rows.append((i, key, None if kind == "many" and rng.random() < 0.01 else at, rng.choice(["a", "b", "error"]), rng.randrange(100)))
    return rows


@pytest.fixture(scope="module", params=["many", "one key", "instant"])
def log(spark, request):
    return spark.createDataFrame(made(request.param), SCHEMA).repartition(5).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 40, 1024])
def test_neighbours(log, cuts):
    got = O.neighbours(log, ["k"], ["at", "s", "i"], previous={"s": "before", "v": "v_before"}, following={"s": "after", "at": "at_after"}, sequence="rn", cuts=cuts)
    w = W.partitionBy("k").orderBy("at", "s", "i")
    want = log.withColumns(
        {"before": F.lag("s").over(w), "v_before": F.lag("v").over(w), "after": F.lead("s").over(w), "at_after": F.lead("at").over(w), "rn": F.row_number().over(w).cast("bigint")}
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("cuts", [1, 40, 1024])
def test_next_match(log, cuts):
    got = O.next_match(log, ["k"], "at", F.col("s") == "error", "nxt", cuts=cuts)
    hits = {}
    for r in log.collect():
        if r.s == "error" and r.at is not None:
            hits.setdefault(r.k, []).append(r.at)
    assert got.count() == log.count()
    for r in got.collect():
        later = [] if r.at is None else [at for at in hits.get(r.k, ()) if at > r.at]
        assert r.nxt == (min(later) if later else None)


@pytest.mark.parametrize("cuts", [1, 40, 1024])
def test_running_sum(log, cuts):
    got = O.running_sum(log, ["k"], "at", "v", "total", cuts=cuts)
    w = W.partitionBy("k").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    assert rows(got) == rows(log.withColumn("total", F.sum("v").over(w)))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(log, reverse, inclusive):
    kinds = {"total": ("sum", "v"), "least": ("min", "v"), "most": ("max", F.col("v") + 1), "x": ("bit_xor", F.xxhash64("i"))}
    got = O.running(log, ["k"], ["at", "i"], kinds, reverse=reverse, inclusive=inclusive, cuts=64)
    turned = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("at", "i")]
    w = W.partitionBy("k").orderBy(*turned).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = log.withColumns({"total": F.sum("v").over(w), "least": F.min("v").over(w), "most": F.max(F.col("v") + 1).over(w), "x": F.bit_xor(F.xxhash64("i")).over(w)})
    assert rows(got) == rows(want)


@pytest.mark.parametrize("cuts", [1, 1024])
def test_totals(log, cuts):
    got = O.neighbours(log, ["k"], ["at", "i"], previous={"v": "before"}, totals={"n": ("sum", "v"), "low": ("min", F.when(F.col("s") == "a", F.col("at"))), "high": ("max", "at")}, cuts=cuts)
    w, key = W.partitionBy("k").orderBy("at", "i"), W.partitionBy("k")
    want = log.withColumns({"before": F.lag("v").over(w), "n": F.sum("v").over(key), "low": F.min(F.when(F.col("s") == "a", F.col("at"))).over(key), "high": F.max("at").over(key)})
    assert rows(got) == rows(want)


@pytest.mark.parametrize("parts", [1, 16])
def test_newest_flag(log, parts):
    got = K.newest_flag(log, ["k"], ["at", "s", "i"], "newest", parts)
    last = F.row_number().over(W.partitionBy("k").orderBy(F.col("at").desc(), F.col("s").desc(), F.col("i").desc())) == 1
    assert rows(got) == rows(log.withColumn("newest", last))
    alike = K.newest_flag(log.select("k"), ["k"], ["k"], "newest", parts)
    assert alike.where("newest").count() == log.select("k").distinct().count()


def test_latest_per_key_reads_once(log):
    got = K.latest_per_key(log, ["k"], "at", F.col("v") > 10)
    newest = {}
    for r in log.collect():
        if r.k is not None and r.at is not None:
            newest[r.k] = max(newest.get(r.k, r.at), r.at)
    want = [tuple(r[c] for c in sorted(log.columns)) for r in log.collect() if r.k is not None and r.at is not None and r.at == newest[r.k] and r.v > 10]
    assert rows(got) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "WindowGroupLimit" in plan


def test_next_end(log):
    got = T.next_end(log, "k", status="s", starts=("a",), ends=("error", "b"), cuts=50)
    ends = {}
    for r in log.collect():
        if r.s != "a" and r.at is not None:
            ends.setdefault(r.k, []).append((r.at, r.s))
    want = set()
    for r in log.collect():
        if r.s == "a" and r.at is not None:
            later = [e for e in ends.get(r.k, ()) if e[0] > r.at]
            want.add((r.k, r.at, *(min(later) if later else (None, None))))
    assert {(r.k, r.started_at, r.ended_at, r.end_status) for r in got.collect()} == want and got.count() == len(want)


def test_next_end_of_cut_events(spark):
    """Events that bring their slices keep them, and starts are not collected into sets."""
    at = [datetime(2024, 1, 1 + i, 10) for i in range(6)]
    log = spark.createDataFrame([("x", t, s) for t, s in zip(at, ["a", "c", "a", "b", "a", "z"])] + [("x", at[1], "b")], "k string, at timestamp_ntz, s string").coalesce(1)
    cut = log.withColumn("_slice", F.when(F.col("at") < at[2], 1).otherwise(2))
    got = T.next_end(cut, "k", status="s", starts=("a",), ends=("c", "b"))
    assert sorted((r.started_at, r.end_status or "", r.ended_at) for r in got.collect()) == [(at[0], "b", at[1]), (at[2], "b", at[3]), (at[4], "", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "TakeOrdered" not in plan


def test_range_join_and_count(spark):
    rng = random.Random(4)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([None, 5.0, 5.0, rng.uniform(-50, 50)])) for i in range(300)]
    spans = [(i, rng.choice(["a", "b", None]), *rng.choice([(None, 3.0), (9.0, 1.0), (5.0, 5.0), (-40.0, 40.0), (lambda x: (x, x + rng.uniform(0, 30)))(rng.uniform(-50, 50))])) for i in range(200)]
    p = spark.createDataFrame(points, "p int, k string, x double")
    r = spark.createDataFrame(spans, "r int, k string, low double, high double")
    for keys in ([], ["k"]):
        hits = [(q[0], s[0]) for q in points for s in spans if q[2] is not None and s[2] is not None and s[2] <= q[2] <= s[3] and (not keys or (q[1] is not None and q[1] == s[1]))]
        for width in (3, 1000):
            left = p if keys else p.drop("k")
            got = R.range_join(left, r, "x", "low", "high", width, keys)
            assert sorted((g.p, g.r) for g in got.collect()) == sorted(hits)
            counted = R.range_count(r, left, "x", "low", "high", width, "n", keys)
            assert {g.r: g.n for g in counted.collect()} == {s[0]: sum(h[1] == s[0] for h in hits) for s in spans}
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_pairs_of_a_range_join_are_spread(spark):
    """Two short tables with very many pairs, all in one bin or over a few: no task makes most of them."""
    points = spark.range(1500).select(F.col("id").alias("p"), (F.col("id") % 30).cast("double").alias("x")).coalesce(1)
    spans = spark.range(1500).select(F.col("id").alias("r"), F.lit(0.0).alias("low"), (F.col("id") % 30).cast("double").alias("high")).coalesce(1)
    for width, most in ((10, 0.2), (1000, 0.3)):
        sizes = [r["count"] for r in R.range_join(points, spans, "x", "low", "high", width).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1500 * 1500 * 31 // 60 and max(sizes) < most * sum(sizes)


@pytest.mark.parametrize("kind", ["one key", "instant"])
def test_a_key_with_all_rows_is_spread(spark, kind):
    log = spark.createDataFrame(made(kind), SCHEMA)
    sizes = [r["count"] for r in O.sliced(log, ["k"], ["at", "s", "i"], 256).groupBy("_slice").count().collect()]
    assert len(sizes) == 257 and max(sizes) < 3000 / 20
    # equal rows give one cut point
    alike = log.select(F.lit("x").alias("k"), F.lit(START).alias("at"))
    assert O.sliced(alike, ["k"], ["at"], 64).select("_slice").distinct().count() == 1


def test_slices_follow_a_prefix_of_the_order(log):
    early = O.sliced(log, ["k"], ["at"], 64)
    got = O.neighbours(early, ["k"], ["at", "s", "i"], previous={"i": "before"}, sequence="rn")
    assert rows(got) == rows(O.neighbours(log, ["k"], ["at", "s", "i"], previous={"i": "before"}, sequence="rn", cuts=1))


def test_building_starts_no_job(spark, log):
    context = spark.sparkContext
    context.setJobGroup("building", "")
    try:
        O.neighbours(log, ["k"], ["at", "s", "i"], previous={"s": "before"}, sequence="rn")
        O.running_sum(log, ["k"], "at", "v", "total")
        O.next_match(log, ["k"], "at", F.col("s") == "error", "nxt")
        assert not context.statusTracker().getJobIdsForGroup("building")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("cuts", [1, 30, 1024])
@pytest.mark.parametrize("min_days", [None, 1, 3])
def test_later_pairs(log, cuts, min_days):
    starts, ends = F.col("s") == "a", F.col("s") == "error"
    few = log.where("i % 3 = 0")
    got = P.later_pairs(few, ["k"], "at", {"at": "a", "i": "x"}, {"at": "b", "i": "y"}, is_first=starts, is_again=ends, min_days=min_days, cuts=cuts)
    local = [r for r in few.collect() if r.k is not None and r.at is not None]
    by_key = {}
    for r in local:
        if r.s == "error":
            by_key.setdefault(r.k, []).append(r)
    want = [
        (r.at, q.at, r.k, r.i, q.i) for r in local if r.s == "a" for q in by_key.get(r.k, ())
        if q.at > r.at and (min_days is None or (q.at.date() - r.at.date()).days >= min_days)
    ]
    assert rows(got) == sorted(want, key=str)


def test_with_missing_is_a_left_join(spark):
    ids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, name string")
    many = spark.createDataFrame([(1, 10), (1, 11), (3, None), (9, 5), (None, 6)], "k int, v int")
    got = S.with_missing(many, ids, ["k"]).join(ids, "k").select("k", "name", "v")
    assert rows(got) == rows(ids.join(many, "k", "left").select("k", "name", "v"))
