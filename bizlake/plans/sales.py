"""Sales, purchasing and design reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.functions import labels as L
from bizlake.functions.text import concat_skip_null, string_agg_distinct
from bizlake.functions.time import day, fmt, in_zone_range, local_ts, ts_lit
from bizlake.operators.changelog import has_text, log_of, parse_once, unpack_changes
from bizlake.operators.cohort import ACTIVE_STATUSES
from bizlake.operators.hours import business_hours, business_hours_case, first_response_hours, with_moments
from bizlake.operators.keys import latest_per_key, newest_flag
from bizlake.operators.orders import last_delivery, status_date
from bizlake.operators.pricing import alloc_factor, band_lookup
from bizlake.operators.repurchase import repurchase
from bizlake.operators.ordered import sliced
from bizlake.operators.sieve import sieve
from bizlake.operators.skew import with_missing
from bizlake.operators.status import END_STATUSES, START_STATUSES, stage_lead_time, status_pairs
from bizlake.plans.common import (
    ADMIN_URL, DMY_SLASH, YMD, admins_as, articles, down, item_costs, local_text, pick, plan_rows,
    products_of, up, with_suppliers,
)
from bizlake.sources.tables import Tables

MOVE_COLUMNS = ["arrived_at", "expected_quantity", "quantity", "scrap_quantity", "exceeding_quantity"]


def _float(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _flag(c: str, yes: str, no: str) -> Column:
    return F.when(F.col(c), yes).otherwise(no)


def _latest_receipts(t: Tables, sales: DataFrame, items: DataFrame | None = None, moves: DataFrame | None = None) -> DataFrame:
    """Distinct newest moves of each item of the ``sales``; an item whose newest move has no quantity has none.

    ``items`` and ``moves`` may hold fewer rows than their tables, if they hold all that the caller's items need.
    """
    orders = sales.select(F.col("id").alias("sale_id"))
    items = t.sale_items if items is None else items
    items = items.select(F.col("id").alias("sale_item_id"), "sale_id").join(orders, "sale_id", "left_semi")
    moves = t.inventory_moves if moves is None else moves
    moves = moves.select("sale_item_id", "created_at", *MOVE_COLUMNS)
    moves = moves.join(items.select("sale_item_id"), "sale_item_id", "left_semi")
    newest = latest_per_key(moves, ["sale_item_id"], "created_at", F.col("quantity").isNotNull())
    return newest.drop("created_at").distinct().withColumnsRenamed({c: f"m_{c}" for c in MOVE_COLUMNS})


def _items(items: DataFrame) -> DataFrame:
    return items.withColumnsRenamed(
        {"id": "sale_item_id", "status": "item_status", "created_at": "item_created_at"}
    )


def _heads(sales: DataFrame) -> DataFrame:
    return sales.withColumnsRenamed({"id": "sale_id"})


def _people(rows: DataFrame, t: Tables) -> DataFrame:
    """Seller, designer and buyer first names; the sale stores the first two as text."""
    rows = rows.withColumnsRenamed({"production_assignee_id": "buyer_user_id"}).withColumns(
        {"seller_id": F.col("seller_id").cast("bigint"), "designer_id": F.col("designer_id").cast("bigint")}
    )
    return (
        rows.join(admins_as(t, "seller"), "seller_id", "left")
        .join(admins_as(t, "designer"), "designer_id", "left")
        .join(admins_as(t, "buyer_user"), "buyer_user_id", "left")
    )


def sales_margin(t: Tables, since: str = "2025-01-01", zone_mode: str = "utc_to_local") -> DataFrame:
    """Sale item: value, allocated value, costs, dates, price band, newest receipt, last delivery."""
    sales = t.sales.where((F.col("created_at") >= ts_lit(since)) & (F.col("status") != "CANCELED"))
    orders = sales.select(F.col("id").alias("sale_id"))
    # The kept orders are few: what cannot belong to them or to their lines is dropped where it is read.
    items = sieve(t.sale_items, orders, "sale_id")
    kept = _items(items).where(F.col("item_status") != "CANCELED").join(orders, "sale_id", "left_semi")
    ids = kept.select("sale_item_id")
    moves = sieve(t.inventory_moves, ids, "sale_item_id")
    firms = pick(t.companies, id="company_id", name="client")
    factors = alloc_factor(sales, items).select("sale_id", "factor")
    started = status_date(sieve(t.sale_status_edits, orders, "sale_id"))
    delivered = last_delivery(sales, items, moves).select("sale_id", "last_delivery_at")
    heads = (
        _people(_heads(sales).join(firms, "company_id"), t)
        .join(factors, "sale_id", "left")
        .join(started, "sale_id", "left")
        .join(delivered, "sale_id", "left")
    )
    # The filtered orders come first, so every later join is over the kept lines only.
    lines = kept.join(heads, "sale_id").join(products_of(t), "product_id", "left")
    priced = band_lookup(
        lines.withColumnRenamed("product_id", "_p").withColumn("product_id", F.when(F.col("sku").isNotNull(), F.col("_p"))),
        t.pricing_ranges.withColumnRenamed("product_cost", "_cost").withColumn("product_cost", _float("_cost")),
    ).withColumnRenamed("product_cost", "band_cost")
    designs = sieve(t.sale_item_design_infos, ids, "sale_item_id").withColumnRenamed("filled", "art_filled").join(ids, "sale_item_id", "left_semi")
    costs = item_costs(t, ids).withColumnRenamed("filled", "cost_filled")
    rows = (
        priced.join(costs, "sale_item_id", "left")
        .join(designs, "sale_item_id", "left")
        .join(_latest_receipts(t, sales, items, moves), "sale_item_id", "left")
    )
    value = _float(F.col("amount") * F.col("final_price"))
    found = F.col("markup").isNotNull()

    def on(c: str) -> Column:
        return local_text(c, DMY_SLASH, zone_mode)

    return rows.select(
        F.col("sale_id").alias("id"),
        "code",
        F.col("amount").alias("quantidade_venda"),
        value.alias("venda_final_item"),
        (value * F.col("factor")).alias("venda_final_item_variacao"),
        day(local_ts("created_at")).alias("created_at"),
        on("expected_delivery").alias("expected_delivery_at"),
        on("event_date").alias("event_at"),
        on("purchase_date").alias("purchase_at"),
        on("customizer_arrival_date").alias("customization_at"),
        on("arrival_forecast_date").alias("expected_arrival_at"),
        F.col("m_arrived_at").alias("arrival_at"),
        on("entered_at").alias("TO_PRODUCE_AT"),
        F.col("last_delivery_at").alias("ultima_entrega"),
        F.col("status").alias("status_pedido"),
        F.col("item_status").alias("status_produto"),
        _flag("is_event", "EVENTO", "").alias("evento"),
        _flag("turbo", "TURBO", "").alias("turbo"),
        "client",
        "sku",
        F.col("product_name").alias("product"),
        F.col("category_name").alias("category"),
        F.col("supplier_name").alias("supplier"),
        F.col("customizer_name").alias("customizer"),
        _float("purchased_quantity").alias("client_quantity"),
        F.coalesce(_float("exceeding_quantity"), F.lit(0.0)).alias("exceeding_quantity"),
        _float(F.col("purchased_quantity") + F.col("exceeding_quantity")).alias("production_quantity"),
        _float("unit_cost").alias("unit_cost"),
        _float("customize_cost").alias("customize_cost"),
        _float(F.col("unit_cost") + F.col("customize_cost")).alias("product_cost"),
        L.price_modifier("price_modifier_type", "price_modifier_value").alias("discount"),
        _float("product_price").alias("product_price"),
        _float("base_price").alias("base_price"),
        _float("final_price").alias("price_with_addons"),
        _float("m_expected_quantity").alias("expected_quantity"),
        _float("m_quantity").alias("received_quantity"),
        _float("m_scrap_quantity").alias("scrap_quantity"),
        F.coalesce(_float("exceeding_quantity"), F.lit(0.0)).alias("exceeding_quantity_2"),
        F.col("seller_name").alias("seller"),
        F.col("buyer_user_name").alias("buyer"),
        F.lit("").alias("cadastro_turbo"),
        _flag("cost_filled", "CUSTO OK", "FALTA CUSTO").alias("custo_disp"),
        _flag("art_filled", "ARTE OK", "FALTA ARTE").alias("arte_disp"),
        F.col("customization_type").alias("tipo_personalizacao"),
        F.col("designer_name").alias("designer"),
        F.when(found, F.col("band")).alias("units"),
        "personalization_cost",
        F.col("band_cost").alias("product_cost_2"),
        "markup",
        "personalization_areas_amount",
        "personalization_colors_amount",
        "customization_colors",
        "art_size",
        "storage",
        "buyer_id",
        "omie_order_code",
        day(local_ts("product_created_at", mode=zone_mode)).alias("product_created_at"),
    )


def year_end_sales(
    t: Tables,
    windows: Sequence[tuple[str, str]] = (("2023-09-01", "2024-01-01"), ("2024-09-01", "2025-01-01")),
) -> DataFrame:
    """Sale items of year-end windows (local days, end exclusive) with a positive allocated value.

    An item whose newest receipts tie with different quantities shows once per receipt.
    """
    inside = F.lit(False)
    for start, end in windows:
        inside = inside | in_zone_range("created_at", start, end)
    sales = t.sales.where(F.col("status").isin(*ACTIVE_STATUSES) & inside)
    firms = pick(t.companies, id="company_id")
    purposes = pick(t.quotes, id="quote_id", kit_purpose="kit_purpose")
    heads = (
        _heads(sales).select("sale_id", "code", "company_id", "quote_id", "created_at")
        .join(firms, "company_id")
        .join(purposes, "quote_id", "left")
        .join(alloc_factor(sales, t.sale_items).select("sale_id", "factor"), "sale_id")
    )
    lines = _items(t.sale_items).where(F.col("item_status") != "CANCELED").select(
        "sale_item_id", "sale_id", "product_id", "amount", "final_price"
    )
    value = _float(F.col("amount") * F.col("final_price")) * F.col("factor")
    rows = lines.join(heads, "sale_id").withColumn("value", value).where(F.col("value") > 0)
    rows = rows.join(products_of(t), "product_id", "left").join(_latest_receipts(t, sales), "sale_item_id", "left")
    return rows.select(
        "code",
        "sku",
        F.col("product_name").alias("produto"),
        F.col("category_name").alias("categoria"),
        F.col("amount").alias("quantidade vendida"),
        F.col("value").alias("valor de venda"),
        F.col("kit_purpose").alias("objetivo do orçamento"),
        day(local_ts("created_at")).alias("created_at"),
    )


def repurchases(t: Tables, min_days: int = 30) -> DataFrame:
    """Company x SKU x purchase pair at least ``min_days`` apart, with allocated values.

    A company with several subscriptions shows each pair once per subscription of both
    purchases; the plans are attached after the pairing, so they do not widen it.
    """
    heads = (
        _heads(t.sales.where(F.col("status") != "CANCELED"))
        .select("sale_id", "code", "company_id", day(local_ts("created_at")).alias("bought_on"))
    )
    factors = alloc_factor(t.sales, t.sale_items).select("sale_id", "factor")
    goods = products_of(t).where(F.col("sku").isNotNull())
    lines = _items(t.sale_items).where(F.col("item_status") != "CANCELED").select("sale_id", "product_id", "amount", "final_price")
    spent = F.round(_float(F.col("amount") * F.col("final_price")) * F.col("factor"), 2).cast("decimal(18,2)")
    base = (
        lines.join(heads.join(factors, "sale_id", "left"), "sale_id")
        .join(goods, "product_id")
        .select("company_id", "sku", "bought_on", "code", "product_name", "category_name", "amount", spent.alias("spent"))
    )
    pairs = repurchase(
        base, ["company_id", "sku"], "bought_on", ["code", "product_name", "category_name", "amount", "spent"], min_days
    )
    firms = pick(t.companies, id="company_id", name="company_name")
    plans = with_missing(plan_rows(t.subscriptions, t.plans), firms, ["company_id"]).withColumn(
        "plan_name", F.coalesce("plan_name", F.lit(L.NO_PLAN))
    )
    # Once for the subscriptions of the earlier purchase, once for those of the later.
    rows = pairs.join(firms, "company_id").join(plans.select("company_id"), "company_id").join(plans, "company_id")
    return rows.select(
        "sku",
        F.col("first_product_name").alias("nome_produto"),
        F.col("company_name").alias("nome_empresa"),
        F.col("first_code").alias("codigo_venda_original"),
        F.col("first_bought_on").alias("data_primeira_compra"),
        F.col("first_amount").alias("quantidade_primeira"),
        F.col("first_spent").alias("valor_primeira"),
        F.col("again_code").alias("codigo_venda_recompra"),
        F.col("again_bought_on").alias("data_recompra"),
        F.col("again_amount").alias("quantidade_recompra"),
        F.col("again_spent").alias("valor_recompra"),
        F.col("days_between").alias("dias_entre"),
        F.col("first_category_name").alias("categoria_primeira"),
        F.col("again_category_name").alias("categoria_recompra"),
        F.col("plan_name").alias("plano"),
    ).orderBy(*up("sku", "nome_empresa", "data_primeira_compra", "data_recompra", "codigo_venda_original"))


def purchase_governance(t: Tables, zone_mode: str = "utc_to_local") -> DataFrame:
    """Open sale items with costs, every receipt and every production start day of the order."""
    sales = t.sales.where(F.col("status").isin("TO_PRODUCE", "PRODUCING", "TO_BILL"))
    firms = pick(t.companies, id="company_id", name="client")
    orders = sales.select(F.col("id").alias("sale_id"))
    items = sieve(t.sale_items, orders, "sale_id")
    with_items = items.select("sale_id").distinct()
    started = (
        sieve(t.sale_status_edits, orders, "sale_id").where(F.col("new_status") == "TO_PRODUCE")
        .select("sale_id", local_text("created_at", DMY_SLASH, zone_mode).alias("TO_PRODUCE_AT"))
        .distinct()
        .join(with_items, "sale_id", "left_semi")
    )
    heads = _people(_heads(sales).join(firms, "company_id"), t).join(started, "sale_id", "left")
    # Only lines of the kept orders are read on, and their tables only as far as they belong to those.
    lines = _items(items).where(~F.col("item_status").isin("CANCELED", "DELIVERED")).join(orders, "sale_id", "left_semi")
    ids = lines.select("sale_item_id").where(F.col("sale_item_id").isNotNull())
    moves = sieve(t.inventory_moves, ids, "sale_item_id").select("sale_item_id", *[F.col(c).alias(f"m_{c}") for c in MOVE_COLUMNS])
    moves = moves.join(ids, "sale_item_id", "left_semi")
    designs = sieve(t.sale_item_design_infos, ids, "sale_item_id").withColumnRenamed("filled", "art_filled").join(ids, "sale_item_id", "left_semi")
    # A line meets its product and its order while it is narrow and by the order already; what belongs to it comes last, so the
    # wide rows move once.
    rows = (
        lines.join(products_of(t), "product_id", "left")
        .join(heads, "sale_id")
        .join(with_missing(moves, ids, ["sale_item_id"]), "sale_item_id")
        .join(item_costs(t, ids).withColumnRenamed("filled", "cost_filled"), "sale_item_id", "left")
        .join(designs, "sale_item_id", "left")
    )

    def on(c: str) -> Column:
        return local_text(c, DMY_SLASH, zone_mode)

    return rows.select(
        F.col("sale_id").alias("id"),
        "code",
        F.col("amount").alias("quantidade_venda"),
        _float(F.col("amount") * F.col("product_price")).alias("venda_original"),
        _float(F.col("amount") * F.col("final_price")).alias("venda_final"),
        on("created_at").alias("created_at"),
        on("expected_delivery").alias("expected_delivery_at"),
        on("event_date").alias("event_at"),
        on("purchase_date").alias("purchase_at"),
        on("customizer_arrival_date").alias("customization_at"),
        on("arrival_forecast_date").alias("expected_arrival_at"),
        on("m_arrived_at").alias("arrival_at"),
        "TO_PRODUCE_AT",
        F.col("status").alias("status_pedido"),
        F.col("item_status").alias("Status_produto"),
        _flag("is_event", "EVENTO", "").alias("EVENTO"),
        _flag("turbo", "TURBO", "").alias("TURBO"),
        "client",
        F.col("product_name").alias("product"),
        F.col("category_name").alias("category"),
        F.col("supplier_name").alias("supplier"),
        F.col("customizer_name").alias("customizer"),
        _float("purchased_quantity").alias("client_quantity"),
        _float("exceeding_quantity").alias("exceeding_quantity"),
        _float(F.col("purchased_quantity") + F.col("exceeding_quantity")).alias("production_quantity"),
        _float("unit_cost").alias("unit_cost"),
        _float("customize_cost").alias("customize_cost"),
        _float(F.col("unit_cost") + F.col("customize_cost")).alias("product_cost"),
        F.lit("").alias("discount"),
        _float("product_price").alias("product_price"),
        _float("base_price").alias("base_price"),
        _float("final_price").alias("price_with_addons"),
        _float("m_expected_quantity").alias("expected_quantity"),
        _float("m_quantity").alias("received_quantity"),
        _float("m_scrap_quantity").alias("scrap_quantity"),
        F.lit("").alias("exceeding_quantity2"),
        F.col("seller_name").alias("seller"),
        F.col("buyer_user_name").alias("buyer"),
        F.col("cost_filled").alias("custo_preenchido"),
        _flag("art_filled", "ARTE OK", "FALTA ARTE").alias("arte_disp"),
        F.col("customization_type").alias("Tipo_personalizacao"),
        F.col("designer_name").alias("designer"),
        "storage",
        "buyer_id",
        "omie_order_code",
    )


def sales_ledger(
    t: Tables,
    start: str = "2025-01-01",
    end: str = "2025-05-15",
    quote_key: str = "quote_id",
    shipment_key: str = "id",
    admin_url: str = ADMIN_URL,
) -> DataFrame:
    """Sale item: wide ledger of sale, item, cost and quote for sales of [start, end) local time.

    ``quote_key`` and ``shipment_key`` name the sale column that points at the quote and
    the shipment. An item shows once per image it has.
    """
    sales = t.sales.where(in_zone_range("created_at", start, end))
    firms = pick(t.companies, id="company_id", name="client_name", cnpj="cnpj")
    quotes = t.quotes.select(
        F.col("id").alias("_quote"),
        *[
            F.col(c).alias(f"quote_{c}")
            for c in (
                "total_price", "shipment_price", "storage_price", "additional_value", "additional_value_description",
                "discount_value", "discount_description",
            )
        ],
        F.col("turbo").alias("quote_turbo"),
        "budget_per_kit",
    )
    trips = t.shipments.select(
        F.col("id").alias("_trip"), F.col("shipment_cost"), F.col("shipment_price").alias("shipment_price_charged")
    )
    people = sales.withColumns(
        {"seller_id": F.col("seller_id").cast("bigint"), "designer_id": F.col("designer_id").cast("bigint")}
    )
    heads = (
        people.withColumns({"_quote": F.col(quote_key), "_trip": F.col(shipment_key)})
        .withColumnRenamed("id", "sale_id")
        .join(firms, "company_id", "left")
        .join(admins_as(t, "seller"), "seller_id", "left")
        .join(admins_as(t, "designer"), "designer_id", "left")
        .join(quotes, "_quote", "left")
        .join(trips, "_trip", "left")
    )
    ids = sales.select(F.col("id").alias("sale_id"))
    items = _items(t.sale_items).select("sale_item_id", "sale_id", "product_id", "item_status", "final_price", "amount")
    items = items.join(ids, "sale_id", "left_semi")
    # Once per image, and once for items without one; the same for sales without items.
    copies = with_missing(t.sale_item_images, items, ["sale_item_id"])
    lines = (
        copies.join(items, "sale_item_id")
        .join(products_of(t), "product_id", "left")
        .join(item_costs(t), "sale_item_id", "left")
        .join(t.sale_item_design_infos.select("sale_item_id"), "sale_item_id", "left")
    )
    known = items.select("sale_id").distinct()
    empty = ids.join(known, "sale_id", "left_anti")
    rows = lines.unionByName(empty, allowMissingColumns=True).join(heads, "sale_id")
    made = F.col("exceeding_quantity") + F.col("purchased_quantity")

    def money(c: Column) -> Column:
        return c.cast("decimal(10,2)")

    return rows.orderBy(down("created_at"), *up("sale_id", "sale_item_id")).select(
        "client_name",
        "cnpj",
        "omie_order_number",
        "code",
        F.col("sale_id").alias("id"),
        "company_id",
        day(local_ts("created_at")).alias("created_at"),
        day(local_ts("order_date")).alias("order_date"),
        F.col("seller_name").alias("seller"),
        F.col("designer_name").alias("designer"),
        "is_event",
        "event_date",
        "deleted_at",
        "total_price",
        "shipment_price",
        "storage_price",
        "additional_value",
        "additional_value_description",
        "discount_value",
        "discount_description",
        "sold_kits_amount",
        concat_skip_null(admin_url, F.col("sale_id").cast("string")).alias("sale_link"),
        "payment_method",
        "number_of_installments",
        "storage",
        "redeem_page",
        "sample",
        F.col("status").alias("sale_status"),
        "product_name",
        F.col("sku").alias("product_sku"),
        F.col("category_name").alias("product_category"),
        "item_status",
        money(F.col("final_price")).alias("final_price"),
        money(F.col("final_price") * F.col("amount")).alias("total_final_price"),
        money(F.col("unit_cost")).alias("unit_cost"),
        money(made * F.col("unit_cost")).alias("total_cost"),
        money(F.col("customize_cost")).alias("customize_cost"),
        money(made * F.col("customize_cost")).alias("total_customize_cost"),
        F.col("supplier_name").alias("supplier"),
        F.col("customizer_name").alias("customizer"),
        "shipment_cost",
        "shipment_price_charged",
        "quote_total_price",
        "quote_shipment_price",
        "quote_storage_price",
        "quote_additional_value",
        "quote_additional_value_description",
        "quote_discount_value",
        "quote_discount_description",
        F.col("quote_turbo").alias("turbo"),
        "budget_per_kit",
        _float("purchased_quantity").alias("client_quantity"),
        _float("exceeding_quantity").alias("exceeding_quantity"),
        _float(made).alias("production_quantity"),
    )


def sale_item_status_times(
    t: Tables, log_since: str = "2024-01-02", month_from: str = "2025-01", merge: bool = True, strict: bool = False
) -> DataFrame:
    """Status changes of sale items with their hours (variant 1), for sales since a month.

    ``merge`` puts changes at the same instants between the same statuses into one row
    (smallest item and sale). The production lead time is one value per item, from its
    first start stage to its last end stage, shown on the newest row of the article
    within the order. With ``strict`` an item has a lead time for every start and later end, which
    multiplies its rows as in the literal report; of the newest ones the longest is shown.
    """
    log = log_of(t.versions, "SaleItem", since=log_since)
    # The slices are found on the plain columns, before anything is parsed.
    log = sliced(log.withColumn("at", local_ts("created_at")), ["item_id"], ["at"])
    events = unpack_changes(log, "status", ["sale_id"], keep=["at", "_slice"]).select(
        "item_id", "at", "_slice", F.col("value").alias("status"), F.col("sale_id").alias("sale_ref")
    ).where(has_text(F.col("status")))
    lead = None
    if strict:
        lead = stage_lead_time(events, "item_id").select(F.col("item_id").cast("bigint").alias("sale_item_id"), "working_hours")
    # Pairs and spans come from one pass over the log.
    changes = status_pairs(events, "item_id", span=(START_STATUSES, END_STATUSES))
    changes, (before, after, first, last) = with_moments(changes, "previous_at", "current_at", "first_start", "last_end")
    changes = changes.withColumns(
        {
            "sale_item_id": F.col("item_id").cast("bigint"),
            "working_hours": F.when(F.col("last_end") > F.col("first_start"), business_hours(first, last)),
            # The leading apostrophe keeps spreadsheets from reading a date.
            "event_month_year": F.concat(F.lit("'"), fmt("previous_at", "yyyy-MM")),
            "case": business_hours_case(before, after),
            "hours": business_hours(before, after),
        }
    )
    grain = ["event_month_year", "previous_status", "current_status", "previous_at", "current_at", "case"]
    if merge:
        changes = changes.groupBy(*grain).agg(
            F.min("sale_ref").alias("sale_ref"), F.min_by("working_hours", "sale_item_id").alias("working_hours"),
            F.min("sale_item_id").alias("sale_item_id"), F.avg("hours").alias("hours"),
        )
    kind = t.sales.schema["id"].dataType
    changes = changes.withColumn("sale_id", F.col("sale_ref").cast(kind))
    heads = t.sales.where(~F.col("status").eqNullSafe(F.lit("CANCELED"))).select(
        F.col("id").alias("sale_id"), "code", "company_id", "is_event", "turbo",
        local_text("created_at", "yyyy-MM").alias("month_year"),
    ).where(F.col("month_year") >= month_from)
    firms = pick(t.companies, id="company_id", name="company_name")
    own = pick(t.customer_products, id="customer_product_id", product_id="_own_product")
    own_goods = products_of(t).withColumnsRenamed(
        {"product_id": "_own_product", "sku": "o_sku", "product_name": "o_name", "category_name": "o_category"}
    ).drop("category_id", "product_created_at")
    lines = t.sale_items.select(F.col("id").alias("sale_item_id"), "product_id", "customer_product_id", "amount")
    infos = t.sale_item_production_infos.select(
        "sale_item_id", F.col("product_supplier_id").alias("supplier_id"), F.col("product_customizer_id").alias("customizer_id")
    )
    # The changes of the kept sales look up names, not all lines: most lines have no such change.
    rows = (
        changes.join(heads.join(firms, "company_id", "left"), "sale_id")
        .join(lines, "sale_item_id", "left")
        .join(infos, "sale_item_id", "left")
    )
    rows = (
        with_suppliers(rows, t)
        .join(own, "customer_product_id", "left")
        .join(own_goods.withColumn("_found", F.lit(True)), "_own_product", "left")
        .join(products_of(t).drop("product_created_at").withColumn("_plain", F.lit(True)), "product_id", "left")
        .withColumns(
            {
                "sku": F.coalesce("o_sku", "sku"),
                "name": F.coalesce("o_name", "product_name"),
                "category": F.coalesce("o_category", "category_name"),
                "goods_id": F.coalesce(F.when(F.col("_found"), F.col("_own_product")), F.when(F.col("_plain"), F.col("product_id"))),
            }
        )
        .withColumn("item_order", F.concat(F.col("goods_id").cast("string"), F.col("code").cast("string")))
    )
    stamp = ["previous_at", "current_at", "sale_item_id", "previous_status", "current_status"]
    if lead is not None:
        rows, stamp = rows.drop("working_hours").join(lead, "sale_item_id", "left"), [*stamp, "working_hours"]
    rows = newest_flag(rows, ["item_order"], stamp, "_newest")
    before = L.map_labels("previous_status", L.SALE_ITEM_STATUS)
    after = L.map_labels("current_status", L.SALE_ITEM_STATUS)
    return rows.select(
        "event_month_year",
        "month_year",
        F.col("code").alias("codigo_venda"),
        F.col("company_name").alias("nome_cliente"),
        "sku",
        F.col("name").alias("nome_sku"),
        F.col("item_order").alias("item_pedido"),
        F.col("supplier_name").alias("fornecedor_produto"),
        before.alias("previous_status"),
        after.alias("current_status"),
        concat_skip_null(before, "->", after).alias("variacao_status"),
        F.col("previous_at").alias("previous_created_at"),
        F.col("current_at").alias("current_created_at"),
        F.col("case").alias("hours_between_status_teste"),
        F.col("hours").alias("avg_hours_between_status"),
        L.quantity_band("amount").alias("faixa_unidades"),
        F.col("category").alias("categoria_produto"),
        L.rush_label("is_event", "turbo").alias("Turbo ou Evento"),
        F.when(F.col("_newest"), F.col("working_hours")).alias("tempo_uteis_producao"),
    ).orderBy(*up("codigo_venda", "previous_created_at", "current_created_at", "item_pedido"))


def art_control(t: Tables, since: str = "2024-01-01", file_key: str = "image_data") -> DataFrame:
    """Quote x product: number of images, first and last image, hours to the first image (variant 3).

    ``file_key`` names the log field that holds the file name. The log is reduced to one
    row per quote item, image and event kind before the join; only minima, maxima and
    distinct images are taken, so nothing is lost.
    """
    parts = {"quote_item_id": "array<string>"}
    parts |= {k: "array<struct<id:string, metadata:struct<filename:string>>>" for k in ("image_data", file_key)}
    changes = F.from_json(F.col("object_changes"), f"struct<{', '.join(f'{k}:{v}' for k, v in parts.items())}>")
    images = (
        parse_once(log_of(t.versions, "QuoteItemImage"), ["created_at", "event"], c=changes)
        .select(
            "created_at",
            "event",
            F.get("c.quote_item_id", F.lit(1)).alias("_item"),
            F.get("c.image_data", F.lit(1)).alias("_image"),
            F.get(f"c.{file_key}", F.lit(1)).alias("_file"),
        )
        .where(F.col("_item").isNotNull())
        .groupBy("_item", "event", F.col("_image.id").alias("image_id"), F.col("_file.metadata.filename").alias("filename"))
        .agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    )
    item_kind = t.quote_items.schema["id"].dataType
    items = t.quote_items.where(F.col("quote_id").isNotNull()).select(
        F.col("id").alias("quote_item_id"), "quote_id", "product_id", F.col("created_at").alias("asked_at")
    )
    images = images.withColumn("quote_item_id", F.col("_item").cast(item_kind)).join(
        items.select("quote_item_id", "quote_id", "product_id"), "quote_item_id"
    ).select("quote_id", "product_id", "event", "image_id", "filename", "first_at", "last_at")

    quotes = t.quotes.where(F.col("created_at") >= ts_lit(since)).select(
        F.col("id").alias("quote_id"), F.col("code").alias("quote_code"), "kit_purpose",
        F.col("created_at").alias("quoted_at"), "designer_id",
    )
    designers = t.admin_users.select(
        F.col("id").alias("designer_id"), F.concat("first_name", F.lit(" "), "last_name").alias("designer")
    )
    sold = t.sales.select("quote_id").dropna().distinct().withColumn("_sold", F.lit(True))
    own = t.customer_products.where(F.col("product_id").isNotNull()).select(
        "product_id", F.col("sku").alias("cp_sku"), F.col("name").alias("cp_name")
    ).distinct()
    wanted = (
        items.drop("quote_item_id").where(F.col("product_id").isNotNull())
        .join(quotes, "quote_id")
        .join(products_of(t).select("product_id", "sku", "product_name", "category_name"), "product_id", "left")
        .join(own, "product_id", "left")
        .join(sold, "quote_id", "left")
        .join(designers, "designer_id", "left")
        .select(
            "quote_id", "product_id", "quote_code", "kit_purpose", "quoted_at", "asked_at", "category_name", "designer",
            F.coalesce("sku", "cp_sku").alias("sku"),
            F.coalesce("product_name", "cp_name").alias("name"),
            F.when(F.col("_sold"), "Sim").otherwise("Não").alias("sold"),
        )
        .distinct()
    )
    made = F.col("event") == "create"
    rows = images.join(wanted, ["quote_id", "product_id"]).groupBy(
        "quote_code", "kit_purpose", "sku", "name", "category_name", "sold", "quoted_at", "designer", "asked_at"
    ).agg(
        F.count_distinct(F.when(made, F.col("image_id"))).alias("n"),
        F.min(F.when(made, F.col("first_at"))).alias("first_made"),
        F.max(F.when(made, F.col("last_at"))).alias("last_made"),
        F.min("first_at").alias("first_any"),
        F.max("last_at").alias("last_any"),
        string_agg_distinct("filename").alias("files"),
    )
    rows = rows.where(F.col("n") > 0).orderBy(down("last_any"), *up("quote_code", "sku"))
    return rows.select(
        F.col("quote_code").alias("Código Orçamento"),
        F.month(day("quoted_at")).alias("Mês Criação Orçamento"),
        F.year(day("quoted_at")).alias("Ano Criação Orçamento"),
        F.col("kit_purpose").alias("Nome Orçamento"),
        F.col("sku").alias("SKU"),
        F.col("name").alias("Nome Produto"),
        F.col("category_name").alias("Categoria Produto"),
        F.col("sold").alias("Virou Venda"),
        F.col("n").alias("Qtd Imagens"),
        F.col("first_made").alias("Data Criação Primeira Imagem"),
        F.col("last_made").alias("Data Criação Última Imagem"),
        F.col("files").alias("Arquivos"),
        F.col("designer").alias("Designer"),
        F.month(day("last_made")).alias("Mês Criação Arte"),
        F.year(day("last_made")).alias("Ano Criação Arte"),
        first_response_hours("asked_at", "first_any", "first_made").alias("Tempo até Primeira Arte"),
    )


def items_without_sku(t: Tables, zone_mode: str = "utc_to_local") -> DataFrame:
    """Sale items whose named customer article has no catalogue SKU."""
    goods = articles(t).where(
        F.col("cp_name").isNotNull() & (F.col("p_sku").isNull() | (F.col("p_sku") == ""))
    ).select("customer_product_id", "cp_name", "p_sku", "p_name")
    heads = pick(t.sales, id="sale_id", created_at="created_at", company_id="company_id").join(
        pick(t.companies, id="company_id", name="company_name"), "company_id", "left"
    )
    infos = t.sale_item_production_infos.select("sale_item_id", "purchased_quantity")
    lines = t.sale_items.where(F.col("customer_product_id").isNotNull()).select(
        F.col("id").alias("sale_item_id"), "sale_id", "customer_product_id", "final_price", "product_supplier_link"
    )
    rows = lines.join(goods, "customer_product_id").join(heads, "sale_id").join(infos, "sale_item_id", "left")
    return rows.select(
        F.col("cp_name").alias("Nome Produto Cliente"),
        F.col("p_sku").alias("SKU Cadastrado"),
        F.col("p_name").alias("Nome Produto Oficial"),
        local_text("created_at", YMD, zone_mode).alias("Data da Venda"),
        F.col("company_name").alias("Cliente"),
        F.col("purchased_quantity").alias("Quantidade Vendida"),
        (F.col("final_price") * F.col("purchased_quantity")).alias("Valor da Venda"),
        F.col("product_supplier_link").alias("Link do Fornecedor"),
    ).orderBy(down("Data da Venda"), *up("Cliente", "Link do Fornecedor"))
