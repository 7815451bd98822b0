"""Reports on their own role schemas: text identifiers, and small literal tables."""

from datetime import datetime
from decimal import Decimal

import pytest

from bizlake.plans import cohorts, customers, products, receipts, sales, shipping
from bizlake.sources.schemas import ROLES
from bizlake.sources.star import star_tables
from bizlake.sources.tables import check_columns, from_frames, from_parquet
from text_roles import plain_rows, text_tables

NOW = "2025-07-01 00:00:00"
REPORTS = {
    "shipments_base": shipping.shipments_base, "shipments_detail": shipping.shipments_detail, "shipping_type_sla": shipping.shipping_type_sla,
    "shipping_status_times": shipping.shipping_status_times, "shipping_queue": lambda t: shipping.shipping_queue(t, NOW),
    "shipments_finance": shipping.shipments_finance, "orders_vs_finance": shipping.orders_vs_finance, "returns": lambda t: shipping.returns(t, NOW),
    "sales_margin": sales.sales_margin, "year_end_sales": sales.year_end_sales, "repurchases": sales.repurchases,
    "purchase_governance": sales.purchase_governance, "sales_ledger": sales.sales_ledger, "sale_item_status_times": sales.sale_item_status_times,
    "art_control": sales.art_control, "items_without_sku": sales.items_without_sku, "product_catalog": lambda t: products.product_catalog(t, NOW),
    "product_first_seen": products.product_first_seen, "cost_adjustments": products.cost_adjustments, "weekly_costs": products.weekly_costs,
    "sku_price_grid": products.sku_price_grid, "supplier_base": products.supplier_base, "customer_success": lambda t: customers.customer_success(t, NOW),
    "customer_credit": customers.customer_credit, "user_directory": customers.user_directory, "active_usage": customers.active_usage_report,
    "stock_report": lambda t: customers.stock_report(t, NOW), "receipt_history": receipts.receipt_history, "open_receipts": receipts.open_receipts,
    "receipt_quality_base": receipts.receipt_quality_base, "loss_reports": receipts.loss_reports, "cohort_customers": cohorts.cohort_customers,
    "cohort": lambda t: cohorts.cohort(t, NOW), "cohort_retention": lambda t: cohorts.cohort_retention_report(t, NOW),
}


def ts(value):
    return datetime.fromisoformat(value)


def frame(spark, role, *rows):
    """A role table from dicts; columns that are not given are NULL."""
    names = [f.name for f in ROLES[role].fields]
    assert all(set(r) <= set(names) for r in rows)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ROLES[role])


def test_there_are_34_reports():
    assert len(REPORTS) == 34


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_runs_on_text_identifiers(spark, name):
    df = REPORTS[name](from_frames(spark, {}))
    assert len(set(df.columns)) == len(df.columns)
    assert df.collect() == []


# Reports over all role tables between them; the others give the same rows too (python tests/text_roles.py runs all).
WITH_VALUES = (
    "art_control", "orders_vs_finance", "purchase_governance", "receipt_quality_base", "returns", "sale_item_status_times", "sales_ledger",
    "shipments_finance", "shipping_queue", "shipping_status_times", "stock_report", "year_end_sales",
)


@pytest.mark.parametrize("name", WITH_VALUES)
def test_text_identifiers_give_the_same_rows(spark, name):
    numbers = star_tables(spark, "/root/testdata/sf0.001")
    want = plain_rows(REPORTS[name](numbers))
    assert want and plain_rows(REPORTS[name](text_tables(numbers))) == want


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="name"):
        check_columns("plans", spark.createDataFrame([("1",)], "id string"))


def test_tables_from_parquet(spark, tmp_path):
    frame(spark, "companies", {"id": "c", "name": "One", "credit_balance": Decimal("3.00")}, {"id": "d", "name": "Two", "credit_balance": Decimal("-1.00")}).write.parquet(
        str(tmp_path / "companies.parquet")
    )
    rows = customers.customer_credit(from_parquet(spark, str(tmp_path))).collect()
    assert [(r.name, r.credit_balance) for r in rows] == [("One", Decimal("3.00"))]


def test_sla_report_counts_pieces_once(spark):
    """Two error episodes and a deleted shipment change neither pieces nor kits."""
    made = ts("2024-05-27 12:00:00")
    change = '{"status":[%s,%s]}'
    log = [
        {"item_type": "ShippingOrder", "item_id": "o1", "event": "update", "object_changes": change % pair, "created_at": ts(at)}
        for pair, at in (
            (('"a"', '"error"'), "2024-05-27 13:00"), (('"error"', '"b"'), "2024-05-27 15:00"),
            (('"b"', '"error"'), "2024-05-28 13:00"), (('"error"', '"b"'), "2024-05-28 19:00"),
        )
    ]
    t = from_frames(spark, {
        "shipping_orders": frame(spark, "shipping_orders", {"id": "o1", "code": "1", "company_id": "c", "status": "shipped", "created_through": "customer_app", "total_kits_quantity": 4, "created_at": made}),
        "shipments": frame(
            spark, "shipments",
            {"id": "a", "shipping_order_id": "o1", "shipped_at": ts("2024-06-03 12:00")}, {"id": "b", "shipping_order_id": "o1", "shipped_at": ts("2024-06-04 12:00")},
            {"id": "x", "shipping_order_id": "o1", "shipped_at": ts("2024-06-04 12:00"), "deleted_at": made}, {"id": "y", "shipping_order_id": "o1"},
        ),
        "shipment_items": frame(
            spark, "shipment_items", {"shipment_id": "a", "customer_product_id": "p", "quantity": 1}, {"shipment_id": "b", "customer_product_id": "p", "quantity": 2},
            {"shipment_id": "b", "customer_product_id": "q", "quantity": 1}, {"shipment_id": "x", "customer_product_id": "p", "quantity": 50},
        ),
        "companies": frame(spark, "companies", {"id": "c", "name": "One"}),
        "subscriptions": frame(spark, "subscriptions", {"company_id": "c", "plan_id": "1"}),
        "plans": frame(spark, "plans", {"id": "1", "name": "Enterprise"}),
        "versions": frame(spark, "versions", *log),
    })
    a, b = shipping.shipping_type_sla(t).collect()
    assert (a["soma_pecas"], b["soma_pecas"], a["Kits enviados"], b["Kits enviados"]) == (1, 3, 1.0, 3.0)
    assert a["Saida Esperada Operação (data)"] == "28-05-2024" and a["Saida esperada Cliente (data)"] == "27-05-2024"
    assert a["Atraso visão operação (sim/não)"] == "sim" and a["Teve erro"] == "sim"
    assert float(a["Tempo em erro (horas)"]) == 6.0
    # 27, 28, 29, 31 May and 3 June; 30 May is closed.
    assert a["Dias (uteis) entre criação do pedido e envio"] == 5


def test_merge_of_simultaneous_changes(spark):
    def row(item, at, new):
        return {"item_type": "ShippingOrder", "item_id": item, "event": "update", "object": "{}", "object_changes": '{"status":[null,"%s"]}' % new, "created_at": ts(at)}

    log = [row(k, at, s) for k in "ab" for at, s in (("2024-05-27 10:00", "draft"), ("2024-05-27 11:00", "mounting"), ("2024-05-27 12:30", "shipped"))]
    t = from_frames(spark, {
        "versions": frame(spark, "versions", *log),
        "shipping_orders": frame(spark, "shipping_orders", {"id": "a", "code": "1", "created_at": ts("2024-05-01 00:00")}, {"id": "b", "code": "2", "created_at": ts("2024-05-01 00:00")}),
    })
    rows = shipping.shipping_status_times(t).collect()
    assert [(r.codes, r.variacao_status, r.avg_hours_between_status) for r in rows] == [("1, 2", "Em montagem->Enviado", 1.5)]
    assert [r.codes for r in shipping.shipping_status_times(t, merge=False).collect()] == ["1", "2"]


def test_lead_time_shows_on_the_newest_row_only(spark):
    def row(at, new):
        return {"item_type": "SaleItem", "item_id": "5", "event": "update", "object": '{"sale_id":"s"}', "object_changes": '{"status":[null,"%s"]}' % new, "created_at": ts(at)}

    log = [row("2025-02-03 12:00", "WAITING"), row("2025-02-03 13:00", "TO_PRODUCE"), row("2025-02-03 14:00", "QUALITY"), row("2025-02-03 15:00", "DELIVERED")]
    t = from_frames(spark, {
        "versions": frame(spark, "versions", *log),
        "sales": frame(spark, "sales", {"id": "s", "code": "9", "company_id": "c", "status": "PRODUCING", "created_at": ts("2025-02-01 00:00"), "is_event": True}),
        "sale_items": frame(spark, "sale_items", {"id": 5, "sale_id": "s", "product_id": "p", "amount": 51}),
        "products": frame(spark, "products", {"id": "p", "sku": "SKU", "name": "Cup"}),
    })
    rows = sales.sale_item_status_times(t).collect()
    assert [r.variacao_status for r in rows] == ["Para produção->Qualidade", "Qualidade->Concluído"]
    assert [r.tempo_uteis_producao for r in rows] == [None, 2.0]
    assert {r["Turbo ou Evento"] for r in rows} == {"EVENTO"} and {r.faixa_unidades for r in rows} == {"2 - 51-100"}
    assert {r.item_pedido for r in rows} == {"p9"} and {r.event_month_year for r in rows} == {"'2025-02"}
