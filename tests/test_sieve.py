"""The sieve keeps every wanted row and drops most others where they are read."""

import pytest
from pyspark.sql import functions as F

from bizlake.operators.sieve import sieve


@pytest.fixture(scope="module")
def rows(spark):
    """20,000 keys, the first 3,000 of them twice, and 500 rows without a key."""
    keys = spark.range(20000).unionAll(spark.range(3000)).withColumn("k", F.col("id") - 7000)
    return keys.unionByName(spark.range(500).withColumn("k", F.lit(None).cast("bigint")))


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_keeps_all_wanted_and_few_others(rows, kind):
    rows = rows.withColumn("k", F.col("k").cast(kind))
    wanted = rows.where("id % 10 = 3").select("k")  # some twice, some without a key
    exact = rows.join(wanted, "k", "left_semi")
    got = sieve(rows, wanted, "k")
    assert sorted(map(tuple, got.join(wanted, "k", "left_semi").collect())) == sorted(map(tuple, exact.collect()))
    assert exact.count() <= got.count() <= exact.count() + 10
    assert got.where("k IS NULL").count() == 0 and got.columns == rows.columns


def test_full_bits_drop_nothing_that_is_wanted(rows):
    wanted = rows.where("id < 2000").select("k")
    got = sieve(rows, wanted, "k", bits=12)
    assert got.join(wanted, "k", "left_semi").count() == rows.join(wanted, "k", "left_semi").count() < got.count() < rows.count()


def test_nothing_wanted_leaves_nothing(rows):
    assert sieve(rows, rows.where("id < 0").select("k"), "k").count() == 0


def test_keys_of_different_types_drop_nothing(rows):
    """An int and a bigint that are equal have different hashes."""
    wanted = rows.where("id = 5").select(F.col("k").cast("int").alias("k"))
    assert sieve(rows, wanted, "k").count() == rows.count()


def test_rows_are_dropped_below_a_grouping(rows):
    """The semi join is under the grouping by the key, and what it broadcasts is bounded by the bits."""
    made = rows.groupBy("k").agg(F.count("*").alias("n")).select((F.col("k") * 2).alias("double"), F.when(F.col("n") > 1, "many").otherwise("one").alias("n"))
    wanted = made.where("n = 'many' AND double IS NOT NULL").select("double")
    got = sieve(made, wanted, "double")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [k") < plan.index("Join LeftSemi")
    assert "rightHint=(strategy=broadcast)" in plan
    assert got.where("n = 'many'").count() == wanted.count() == 3000
