"""Joins on a range: x BETWEEN low AND high, by bins instead of comparing every row with every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.operators.ordered import same

PIECES = 4


def bin_of(x: Column, width: float) -> Column:
    """The number of the bin that holds a number or a date (days since 1970)."""
    return F.floor(x / F.lit(float(width))).cast("bigint")


def _number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    return F.unix_date(c).cast("double") if kind == "date" else F.col(c).cast("double")


def _piece(df: DataFrame, pieces: int) -> Column:
    """A number below ``pieces`` by the row's content."""
    return F.pmod(F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind]), F.lit(pieces)).cast("int")


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    x: str,
    low: str,
    high: str,
    width: float,
    keys: Sequence[str] = (),
    pieces: int = PIECES,
) -> DataFrame:
    """Every point with every range that holds it (``low <= x <= high``), of equal ``keys`` if given; the columns of both.

    A range is repeated once per bin of ``width`` that it touches and meets the points of those bins in an equi join; the bin
    is part of the join key, so a key with very many points is spread over its bins. A width near the usual length of a range
    is best: narrower bins repeat ranges, wider ones compare more points. NULLs meet nothing; a range with ``high < low`` holds nothing. Apart from
    ``keys`` the two sides must not share column names. x, low and high are numbers or dates.

    The pairs are the result and may outnumber the rows by far, which Spark cannot see from the size of the inputs: it would
    put all bins of two short tables into one task. So each bin is a square of ``pieces`` by ``pieces`` blocks (a row is copied
    ``pieces`` times), and the blocks go to a fixed number of tasks, which are not merged again.
    """
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    on = [*keys, "_bin", "_here", "_there"]
    held = points.where(F.col(x).isNotNull()).withColumns({"_bin": bin_of(_number(points, x), width), "_here": _piece(points, pieces)})
    first, last = bin_of(_number(ranges, low), width), bin_of(_number(ranges, high), width)
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_there", _piece(ranges, pieces)).withColumn("_bin", F.explode(F.sequence(first, last)))
    left = held.withColumn("_there", every).repartition(tasks, *on)
    right = spread.withColumn("_here", every).repartition(tasks, *on)
    return left.join(right, on).where(F.col(x).between(F.col(low), F.col(high))).drop("_bin", "_here", "_there")


def range_count(
    ranges: DataFrame,
    points: DataFrame,
    x: str,
    low: str,
    high: str,
    width: float,
    out: str = "n",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``ranges`` with the number of points in each (0 where none, also for NULL or empty ranges): a left range join, counted.

    Equal ranges are counted once, and points are counted per value before they meet them, so neither many equal points nor
    many equal ranges make pairs. Bins that lie wholly inside a range are met as one row with their total; only the bins
    at both ends are looked into.
    """
    spans = ranges.where(F.col(low) <= F.col(high)).select(*keys, low, high).distinct()
    for k in keys:
        spans = spans.where(F.col(k).isNotNull())
    by_value = points.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n")).withColumn("_bin", bin_of(_number(points, x), width))
    totals = by_value.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    first, last = bin_of(_number(ranges, low), width), bin_of(_number(ranges, high), width)
    placed = spans.withColumns({"_first": first, "_last": last})
    inner = placed.where("_last - _first > 1").select(*keys, low, high, F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)).alias("_bin"))
    ends = placed.select(*keys, low, high, F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_bin"))
    whole = inner.join(totals, [*keys, "_bin"]).select(*keys, low, high, "_n")
    partly = ends.join(by_value, [*keys, "_bin"]).where(F.col(x).between(F.col(low), F.col(high))).select(*keys, low, high, "_n")
    counts = whole.unionByName(partly).groupBy(*keys, low, high).agg(F.sum("_n").alias(out))
    on = [*keys, low, high]
    named = counts.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return ranges.join(named, same(on), "left").drop(*[f"_on_{c}" for c in on]).withColumn(out, F.coalesce(out, F.lit(0)))
