"""Small literal inputs for the rules that are easy to get wrong."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bizlake.functions import changes, labels, text, time
from bizlake.operators import changelog, cohort, keys, orders, pricing, repurchase, status, stock, usage

D = Decimal


def ts(value):
    return datetime.fromisoformat(value)


def test_json_null_negative_index_and_missing_key(spark):
    rows = [('{"status":["a","b"]}',), ('{"status":[null,"b"]}',), ('{"status":["a",null]}',), ('{"other":[1,2]}',), ("{}",), (None,), ("broken",)]
    df = spark.createDataFrame(rows, "j string").select("*", changes.change_pair("j", "status").alias("p"))
    got = [
        tuple(r)
        for r in df.select(changes.old_of("p"), changes.new_of("p"), changes.last_of("p"), changes.has_key("j", "status")).collect()
    ]
    assert got[:5] == [("a", "b", "b", True), (None, "b", "b", True), ("a", None, None, True), (None, None, None, False), (None, None, None, False)]
    assert got[5][:3] == got[6][:3] == (None, None, None)


def test_unpack_falls_back_to_the_snapshot(spark):
    log = spark.createDataFrame(
        [("1", ts("2024-01-01 00:00"), "update", '{"status":"S","sale_id":"7"}', '{"amount":[1,2]}'),
         ("2", ts("2024-01-01 00:00"), "update", '{"status":"S","sale_id":7}', '{"status":["A","B"]}')],
        "item_id string, created_at timestamp_ntz, event string, object string, object_changes string",
    )
    got = {r.item_id: (r.old_value, r.new_value, r.value, r.sale_id) for r in changelog.unpack_changes(log, "status", ["sale_id"]).collect()}
    assert got == {"1": (None, None, "S", "7"), "2": ("A", "B", "B", "7")}


def test_status_pairs_drop_the_first_pair_and_repeats(spark):
    events = [("x", f"2024-01-01 0{i}:00", s) for i, s in enumerate("ABBCCA")] + [("y", "2024-01-01 00:00", "A"), ("y", "2024-01-01 01:00", "B")]
    df = spark.createDataFrame([(k, ts(t), s) for k, t, s in events] + [("x", ts("2024-01-01 03:30"), ""), ("x", ts("2024-01-01 03:40"), None)], "k string, at timestamp_ntz, status string")
    got = sorted((r.k, r.previous_status, r.current_status) for r in status.status_pairs(df, "k").collect())
    assert got == [("x", "B", "C"), ("x", "C", "A")]


def test_status_pairs_order_ties_by_status(spark):
    df = spark.createDataFrame([("x", ts("2024-01-01 00:00"), "A"), ("x", ts("2024-01-01 01:00"), "C"), ("x", ts("2024-01-01 01:00"), "B"), ("x", ts("2024-01-01 02:00"), "D")], "k string, at timestamp_ntz, status string")
    got = [(r.previous_status, r.current_status) for r in status.status_pairs(df, "k").orderBy("previous_at", "previous_status").collect()]
    assert got == [("B", "C"), ("C", "D")]


def error_log(spark, rows):
    return spark.createDataFrame(
        [("ShippingOrder", k, "update", "{}", f'{{"status":[{o},{n}]}}', ts(t)) for k, t, o, n in rows],
        "item_type string, item_id string, event string, object string, object_changes string, created_at timestamp_ntz",
    )


def test_error_episodes(spark):
    log = error_log(spark, [
        ("1", "2024-01-01 00:00", '"a"', '"error"'), ("1", "2024-01-02 12:00", '"error"', '"b"'),
        ("1", "2024-01-05 00:00", "null", '"error"'), ("1", "2024-01-05 01:00", '"error"', '"error"'), ("1", "2024-01-05 03:00", '"error"', '"b"'),
        ("2", "2024-01-01 00:00", '"a"', '"error"'),
        ("3", "2024-01-01 00:00", '"a"', '"error"'), ("3", "2024-01-01 00:00", '"error"', '"b"'),
    ])
    got = sorted((r.item_id, r.entered_at, r.left_at, r.days, r.hours) for r in changelog.error_episodes(log).collect())
    assert got == [
        ("1", ts("2024-01-01 00:00"), ts("2024-01-02 12:00"), D("1.50"), D("36.00")),
        ("1", ts("2024-01-05 00:00"), ts("2024-01-05 01:00"), D("0.04"), D("1.00")),
        ("1", ts("2024-01-05 01:00"), ts("2024-01-05 03:00"), D("0.08"), D("2.00")),
    ]


def test_latest_keeps_ties_and_filters_afterwards(spark):
    df = spark.createDataFrame(
        [("a", 1, 5), ("a", 2, 6), ("a", 2, 7), ("b", 1, 1), ("b", 2, None)], "k string, t int, q int"
    )
    got = sorted((r.k, r.q) for r in keys.latest_per_key(df, ["k"], "t", F.col("q").isNotNull()).collect())
    assert got == [("a", 6), ("a", 7)]


def test_first_and_last_per_key_null_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 3, 2), ("a", 5, 3)], "k string, o int, v int")
    assert keys.first_per_key(df, ["k"], ["o"]).first().v == 2
    assert keys.last_per_key(df, ["k"], ["o"]).first().v == 1
    assert keys.last_per_key(df, ["k"], ["o"], nulls_last=True).first().v == 3


def sales_and_items(spark):
    sales = spark.createDataFrame(
        [("s1", "1", D("90.00"), "OK"), ("s2", "2", D("50.00"), "OK"), ("s3", "3", D("70.00"), "CANCELED"), ("s4", "4", D("10.00"), None)],
        "id string, code string, total_price decimal(18,2), status string",
    )
    items = spark.createDataFrame(
        [("s1", 1, D("40.00"), "X"), ("s1", 2, D("30.00"), "X"), ("s1", 9, D("99.00"), "CANCELED"), ("s2", 1, D("0.00"), "X"), ("s3", 1, D("5.00"), "X"), ("s4", 1, D("5.00"), "X")],
        "sale_id string, amount int, final_price decimal(18,2), status string",
    )
    return sales, items


def test_allocation_adds_up_to_the_order_total(spark):
    sales, items = sales_and_items(spark)
    factors = {r.sale_id: r.factor for r in pricing.alloc_factor(sales, items).collect()}
    assert factors == {"s1": pytest.approx(0.9), "s2": 1.0}
    lines = pricing.allocate(sales, items.where("status != 'CANCELED'"))
    total = lines.where("sale_id = 's1'").agg(F.sum("allocated_value")).first()[0]
    assert total == pytest.approx(90.0)


def test_volume_bands(spark):
    df = spark.createDataFrame([(x,) for x in (1, 50, 51, 100, 101, 250, 251, 500, 501, 1000, 1001)] + [(None,)], "q int")
    got = [r.b for r in df.select(pricing.volume_band("q").alias("b")).collect()]
    assert got == [50, 50, 100, 100, 250, 250, 500, 500, 1000, 1000, 1000, 1000]


def test_label_bands_and_maps(spark):
    df = spark.createDataFrame([(49,), (50,), (300,), (301,), (999,), (1000,), (None,)], "q int")
    got = [r.b for r in df.select(labels.employee_band("q").alias("b")).collect()]
    low, mid, high, top = labels.EMPLOYEE_LABELS
    assert got == [low, mid, mid, high, high, top, top]
    codes = spark.createDataFrame([("WAITING",), ("???",), (None,)], "c string")
    got = [tuple(r) for r in codes.select(labels.map_labels("c", labels.SALE_ITEM_STATUS), labels.map_labels("c", labels.ASSEMBLY_TYPE, "desconhecido")).collect()]
    assert got == [("Aguardando", "desconhecido"), ("???", "desconhecido"), (None, "desconhecido")]
    ranks = [r[0] for r in codes.select(labels.priority("c", ["x", "WAITING"])).collect()]
    assert ranks == [2, 3, 3]


def test_age_and_rush_labels(spark):
    df = spark.createDataFrame([(ts(t) if t else None,) for t in ("2025-05-01 00:00", "2025-06-01 00:00", "2025-06-29 23:59", "2025-06-30 00:01", None)], "d timestamp_ntz")
    got = [r[0] for r in df.select(labels.age_bucket("d", "2025-07-01 00:00:00")).collect()]
    assert got == ["Erro", "BackLog", "BackLog", "Demanda Futura", "Demanda Futura"]
    flags = spark.createDataFrame([(True, True), (True, None), (None, True), (False, None)], "e boolean, t boolean")
    assert [r[0] for r in flags.select(labels.rush_label("e", "t")).collect()] == ["TURBO+EVENTO", "EVENTO", "TURBO", "PADRAO"]


def test_text_rules(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "x", "b"), (None, None, "c")], "k string, v string, w string")
    got = {r.k: (r.s, r.n) for r in df.groupBy("k").agg(text.string_agg_distinct("v").alias("s"), text.string_agg_distinct(F.upper("w")).alias("n")).collect()}
    assert got == {"a": ("x", "B"), None: (None, "C")}
    one = spark.range(1).select(text.concat_skip_null(F.lit(None).cast("string"), " ", F.lit("z")).alias("c"), text.decimal_comma(F.lit("1.50")).alias("d"), text.first_part(F.lit(" S1 - x")).alias("p")).first()
    assert tuple(one) == (" z", "1,50", "S1")


def test_matching_descriptions(spark):
    rows = [('[{"description":"Objeto NÃO entregue - b"},{"description":"x"},{"description":"objeto não entregue"},{"description":null}]',), ("[]",), (None,), ('[{"other":1}]',)]
    df = spark.createDataFrame(rows, "j string")
    got = [r[0] for r in df.select(text.matching_descriptions("j", "%Objeto não entregue%")).collect()]
    assert got == ["Objeto NÃO entregue - b, objeto não entregue", None, None, None]


def test_week_month_quarter(spark):
    df = spark.createDataFrame([(ts("2024-12-30 10:00"),), (ts("2025-01-05 23:59"),)], "t timestamp_ntz")
    got = [tuple(r) for r in df.select(time.week_label("t"), time.quarter_label(time.quarter_index("t")), time.dow_sunday0("t")).collect()]
    assert got == [("Semana 01 - 30/12/2024", "2024 Q4", 1), ("Semana 01 - 30/12/2024", "2025 Q1", 0)]


def test_local_time_and_range(spark):
    df = spark.createDataFrame([(ts("2025-01-01 02:59:59"),), (ts("2025-01-01 03:00:00"),)], "t timestamp_ntz")
    got = [tuple(r) for r in df.select(time.local_ts("t"), time.local_ts("t", mode="assume_local"), time.in_zone_range("t", "2025-01-01")).collect()]
    assert got == [(ts("2024-12-31 23:59:59"), ts("2025-01-01 05:59:59"), False), (ts("2025-01-01 00:00"), ts("2025-01-01 06:00"), True)]


def test_range_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(ts("2025-01-01 02:59:59"),)], "t timestamp_ntz").write.parquet(path)
    plan = spark.read.parquet(path).where(time.in_zone_range("t", "2025-01-01", "2025-02-01"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,2025-01-01T03:00" in plan and "LessThan(t,2025-02-01T03:00" in plan


def test_repurchase_gap_and_null_keys(spark):
    rows = [("c", "s", date(2024, 1, 1), 1), ("c", "s", date(2024, 1, 31), 2), ("c", "s", date(2024, 1, 30), 3), ("c", "s", date(2024, 6, 1), 4), ("c", None, date(2024, 1, 1), 5), ("d", "s", date(2024, 6, 1), 6)]
    df = spark.createDataFrame(rows, "company string, sku string, d date, n int")
    got = sorted((r.first_n, r.again_n, r.days_between) for r in repurchase.repurchase(df, ["company", "sku"], "d", ["n"]).collect())
    assert got == [(1, 2, 30), (1, 4, 152), (2, 4, 122), (3, 4, 123)]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 10), ("b", 0, 5), ("c", None, 5)], "k string, n int, kits int")
    got = sorted((r.k, r.n, r.share) for r in orders.share_of_total(df, ["k"], "n", "kits", "share", 1).collect() if r.k != "c")
    assert got == [("a", 1, 2.5), ("a", 3, 7.5), ("b", 0, None)]


def test_receipt_quantity_fallback(spark):
    moves = spark.createDataFrame(
        [("p", None, "RECEIPT", "COMPLETED", 9, 8), ("x", "p", "RECEIPT", "COMPLETED", 1, 3), ("y", "p", "customer_input", "TO_CHECK", 1, 4),
         ("z", "p", "RECEIPT", "CANCELED", 1, 50), ("q", None, "RECEIPT", "COMPLETED", None, 8)],
        "id string, parent_id string, operation_type string, status string, quantity int, expected_quantity int",
    )
    got = {r.id: r.received for r in stock.receipt_qty(moves, moves).collect()}
    assert got == {"p": 7, "x": 1, "y": 1, "z": 1, "q": 8}


def test_active_usage(spark):
    rows = [("1", '{"signin_token":["t",null]}', "2025-05-05 00:00"), ("1", '{"signin_token":["t",null]}', "2025-05-11 23:59"),
            ("1", '{"signin_token":[null,"t"]}', "2025-05-06 00:00"), ("1", '{"signin_token":["t",null]}', "2025-05-04 23:59"), ("1", '{"x":[1,null]}', "2025-05-06 00:00")]
    log = spark.createDataFrame([("User", i, j, ts(t)) for i, j, t in rows], "item_type string, item_id string, object_changes string, created_at timestamp_ntz")
    got = sorted((str(r.week), r.accesses, r.accesses_in_week) for r in usage.active_usage(log).collect())
    assert got == [("2025-05-05", 2, 2)]


def test_cohort_running_sums_and_closed_quarters(spark):
    sales = spark.createDataFrame(
        [(i, "c1", ts(t), D(p), "PRODUCING") for i, t, p in (("1", "2024-01-10 00:00", "10.00"), ("2", "2024-02-10 00:00", "10.00"), ("3", "2024-07-01 00:00", "5.00"))],
        "id string, company_id string, created_at timestamp_ntz, total_price decimal(18,2), status string",
    )
    firms = spark.createDataFrame([("c1", "One", 20)], "id string, name string, employees_quantity int")
    subs = spark.createDataFrame([], "company_id string, plan_id string")
    plans = spark.createDataFrame([], "id string, name string")
    delivered = spark.createDataFrame([("c1", 2024 * 4 + 2)], "company_id string, quarter_idx int")
    members = cohort.cohort_first(sales, firms, subs, plans)
    grid = {r.relative_quarter: r for r in cohort.cohort_matrix(members, sales, delivered, "2024-10-01 00:00:00").collect()}
    assert sorted(grid) == [1, 2, 3]
    assert [grid[q].revenue_in_quarter for q in (1, 2, 3)] == [D("10.00"), D("0.00"), D("5.00")]
    assert [grid[q].cumulative_orders for q in (1, 2, 3)] == [2, 2, 3]
    assert [grid[q].retencao_envio for q in (1, 2, 3)] == [0, 0, 1]
    assert [float(grid[q].percentual_receita_vs_q1) for q in (1, 2, 3)] == [100.0, 0.0, 50.0]
    kept = {r.relative_quarter: r for r in cohort.cohort_retention(members, sales, delivered, "2024-10-01 00:00:00").collect()}
    assert kept[1].revenue_in_quarter == D("20.00") and kept[3].cumulative_revenue == D("25.00")


def test_cohort_counts_copy_no_rows(spark):
    from bizlake.catalog import load

    plan = load()[0]["d_cohort_matrix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_reports_read_each_fact_a_bounded_number_of_times(spark):
    """Static plans, before runtime reuse: files read in all, and reads of the largest table."""
    import re

    from bizlake.catalog import load

    bounds = {"d_latest_per_key": (1, 1), "r_stock": (26, 5), "r_year_end_sales": (12, 4), "r_shipments_base": (9, 4), "d_status_pairs": (4, 0), "q_range_join": (2, 0)}
    for key, (files, lines) in bounds.items():
        plan = load()[0][key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"Scan parquet.*", plan)
        assert len(scans) <= files and sum("lineitem" in x for x in scans) <= lines, key
