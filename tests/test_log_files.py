"""The change log stored by entity type and month: rows survive, folders are pruned by constants and by a join."""

import pytest
from pyspark.sql import functions as F

from bizlake.operators.changelog import log_of
from bizlake.sources.schemas import ROLES
from bizlake.sources.log_files import month_of, read_log, write_log
from bizlake.sources.star import star_tables
from bizlake.sources.tables import from_parquet

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "versions.parquet")
    odd = spark.createDataFrame([(None, "1", "update", None, None, None)], ROLES["versions"])
    write_log(star_tables(spark, SF).versions.unionByName(odd), path)
    return path


def scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_survive(spark, stored):
    want, got = star_tables(spark, SF).versions, read_log(spark, stored)
    assert got.count() == want.count() + 1
    assert got.drop("log_month").where("item_type IS NOT NULL").exceptAll(want).count() == 0
    assert from_parquet(spark, stored.rsplit("/", 1)[0]).versions.columns == got.columns


def test_constants_choose_folders(spark, stored):
    got = log_of(read_log(spark, stored), "SaleItem", "Shipment", since="2020-03-15", until="2020-06-10")
    want = log_of(star_tables(spark, SF).versions, "SaleItem", "Shipment", since="2020-03-15", until="2020-06-10")
    assert got.drop("log_month").exceptAll(want).count() == 0 and got.count() == want.count() > 0
    plan = scans(got)
    filters = plan[plan.index("PartitionFilters: [") :].split("PushedFilters")[0]
    assert "item_type" in filters and "log_month" in filters
    files = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert all(("SaleItem" in f or "Shipment" in f) and any(f"2020-0{m}" in f for m in (3, 4, 5, 6)) for f in files)


def test_a_join_chooses_folders_at_run_time(spark, stored):
    sales = star_tables(spark, SF).sales
    busy = sales.groupBy(month_of("created_at").alias("log_month")).agg(F.count("*").alias("n")).where("n > 22")
    log = log_of(read_log(spark, stored), "SaleItem")
    got = log.join(busy, "log_month").groupBy("log_month").agg(F.count("*").alias("changes"))
    plan = scans(got)
    assert "dynamicpruning" in plan.lower()
    want = log.groupBy("log_month").count().collect()
    months = {r["log_month"] for r in busy.collect()}
    assert {(r[0], r[1]) for r in got.collect()} == {(r[0], r[1]) for r in want if r[0] in months} != set()
