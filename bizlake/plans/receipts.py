"""Goods-receipt and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.functions import labels as L
from bizlake.functions.time import day, in_zone_range, local_ts, ts_lit
from bizlake.operators.skew import with_missing
from bizlake.operators.stock import RECEIPT_MOVES, receipt_qty
from bizlake.plans.common import DMY_SLASH, HOUSE, articles, down, item_costs, local_text, pick, plan_rows, up
from bizlake.sources.tables import Tables

MISSING = "Não informado"


def _company_plans(t: Tables) -> DataFrame:
    """Owner with name and plan; once per subscription."""
    firms = pick(t.companies, id="owner_id", name="company_name")
    plans = plan_rows(t.subscriptions, t.plans).withColumnRenamed("company_id", "owner_id")
    rows = firms.join(plans, "owner_id", "left")
    return rows.withColumn("plan_name", F.coalesce("plan_name", F.lit(L.NO_PLAN)))


def _receipts(t: Tables, receipts: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Moves with received pieces, article, company and plan."""
    return (
        receipt_qty(t.inventory_moves, receipts, excluded)
        .join(articles(t), "customer_product_id", "left")
        .join(_company_plans(t), "owner_id", "left")
    )


def _kind(house: str):
    return F.when(F.col("operation_type") == "RECEIPT", f"Recebimento {house}").otherwise("Recebimento Terceiro")


def receipt_history(
    t: Tables, since: str = "2023-10-01", house: str = HOUSE, zone_mode: str = "utc_to_local"
) -> DataFrame:
    """Completed receipts that arrived since a local day, newest change first."""
    if zone_mode == "utc_to_local":
        period = in_zone_range("arrived_at", since)
    else:
        period = local_ts("arrived_at", mode=zone_mode) >= ts_lit(since)
    done = t.inventory_moves.where(
        (F.col("status") == "COMPLETED") & F.col("operation_type").isin(*RECEIPT_MOVES)
        & F.col("arrived_at").isNotNull() & period
    )
    rows = _receipts(t, done, ("CANCELED",)).join(
        item_costs(t).select("sale_item_id", "supplier_name", "customizer_name"), "sale_item_id", "left"
    )
    return rows.orderBy(down("updated_at"), *up("id")).select(
        local_text("created_at", DMY_SLASH, zone_mode).alias("Data_criacao"),
        local_text("arrived_at", DMY_SLASH, zone_mode).alias("Data_chegada"),
        local_text("arrived_at", "MM/yyyy", zone_mode).alias("Mes_ano_chegada"),
        _kind(house).alias("Tipo_Recebimento"),
        F.col("company_name").alias("Empresa"),
        F.col("cp_sku").alias("SKU"),
        F.coalesce("p_name", "cp_name").alias("Produto"),
        F.col("category_name").alias("Categoria"),
        F.col("cp_note").alias("Venda"),
        F.col("received").alias("Quantidade"),
        F.col("unit_price").alias("Valor_unitario"),
        (F.col("received") * F.col("unit_price")).alias("Valor_total"),
        F.col("supplier_name").alias("Fornecedor"),
        F.col("customizer_name").alias("Fornecedor de Personalizacao"),
        L.map_labels("status", L.RECEIPT_STATUS).alias("Status"),
        F.col("notes").alias("Comentários"),
        # The plan comes through the company, so an article without one has none.
        F.col("plan_name").alias("Plano"),
    )


def open_receipts(t: Tables, house: str = HOUSE, zone_mode: str = "utc_to_local") -> DataFrame:
    """Receipts that are neither completed nor cancelled."""
    still_open = t.inventory_moves.where(
        ~F.col("status").isin("COMPLETED", "CANCELED") & F.col("operation_type").isin(*RECEIPT_MOVES)
    )
    rows = _receipts(t, still_open, ("COMPLETED", "CANCELED"))
    name = F.when(F.col("product_id").isNotNull(), F.col("p_name")).otherwise(F.col("cp_name"))
    return rows.orderBy(*up("company_name", "plan_name", "category_name", name, "id")).select(
        local_text("created_at", DMY_SLASH, zone_mode).alias("Data_criacao"),
        local_text("estimated_arrival_date", DMY_SLASH, zone_mode).alias("data_estimada_recebimento"),
        _kind(house).alias("Tipo Recebimento"),
        F.col("company_name").alias("Empresa"),
        F.col("plan_name").alias("Plano"),
        F.col("cp_sku").alias("SKU"),
        name.alias("Produto"),
        F.col("category_name").alias("Categoria"),
        F.col("cp_note").alias("Obs_interna"),
        F.col("reference_code").alias("Venda"),
        F.col("received").alias("Quantidade"),
        F.col("unit_price").alias("Valor_unitario"),
        (F.col("received") * F.col("unit_price")).alias("Valor_total"),
        L.map_labels("status", L.RECEIPT_STATUS).alias("Status"),
        F.col("notes").alias("Comentários"),
    )


def receipt_quality_base(t: Tables, since: str = "2024-09-01") -> DataFrame:
    """Sold item x received article with its suppliers, for items created since a day."""
    firms = pick(t.companies, id="owner_id", name="company_name")
    goods = articles(t).join(firms, "owner_id", "left").select(
        "customer_product_id", "cp_note", "company_name", "cp_sku",
        F.coalesce("p_name", "cp_name").alias("product"), "category_name",
    )
    # Only the article of a move matters here, so repeated moves are dropped before the joins.
    moved = t.inventory_moves.where(F.col("sale_item_id").isNotNull()).select("sale_item_id", "customer_product_id").distinct()
    items = t.sale_items.where(F.col("created_at") >= ts_lit(since)).select(
        F.col("id").alias("sale_item_id"), "amount",
        F.month(day("created_at")).alias("month"), F.year(day("created_at")).alias("year"),
    )
    unique = (
        with_missing(moved, items, ["sale_item_id"]).join(items, "sale_item_id")
        .join(goods, "customer_product_id", "left")
        .drop("customer_product_id")
        .distinct()
    )
    rows = unique.join(item_costs(t).select("sale_item_id", "supplier_name", "customizer_name"), "sale_item_id", "left")
    return rows.orderBy(*up("cp_note", "cp_sku", "sale_item_id")).select(
        F.col("cp_note").alias("Código da Venda"),
        F.col("company_name").alias("Cliente"),
        F.col("cp_sku").alias("SKU"),
        F.col("product").alias("Produto"),
        F.col("category_name").alias("Categoria do Produto"),
        F.coalesce("supplier_name", F.lit(MISSING)).alias("Fornecedor do Produto"),
        F.coalesce("customizer_name", F.lit(MISSING)).alias("Fornecedor de Personalização"),
        F.col("amount").alias("Quantidade de Itens Vendidos"),
        F.col("month").alias("Mês"),
        F.col("year").alias("Ano"),
    )


def loss_reports(t: Tables) -> DataFrame:
    """Loss report with reason label, article and suppliers."""
    moves = t.inventory_moves.select(F.col("id").alias("inventory_move_id"), "sale_item_id", "customer_product_id")
    items = t.sale_items.select(F.col("id").alias("sale_item_id"), "amount", F.col("created_at").alias("sold_at"))
    costs = item_costs(t).select("sale_item_id", "supplier_name", "customizer_name")
    firms = pick(t.companies, id="owner_id", name="company_name")
    rows = (
        t.loss_reports.join(moves, "inventory_move_id", "left")
        .join(items.join(costs, "sale_item_id", "left"), "sale_item_id", "left")
        .join(articles(t).join(firms, "owner_id", "left"), "customer_product_id", "left")
    )
    return rows.select(
        F.col("cp_note").alias("Código da Venda"),
        F.col("company_name").alias("Cliente"),
        F.col("cp_sku").alias("SKU"),
        F.coalesce("p_name", "cp_name").alias("Produto"),
        L.map_labels("reason", L.LOSS_REASON).alias("Razão do Relatório de Perda"),
        F.col("quantity").alias("Quantidade Relatada na Perda"),
        F.col("created_at").alias("Criado em"),
        F.col("supplier_name").alias("Fornecedor do Produto"),
        F.col("customizer_name").alias("Fornecedor de Personalização"),
        F.col("category_name").alias("Categoria do Produto"),
        F.col("amount").alias("Qtdade Total"),
        F.month(day("sold_at")).alias("Mês"),
        F.year(day("sold_at")).alias("Ano"),
    )
