"""Shipping reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.functions import labels as L
from bizlake.functions.text import concat_skip_null, matching_descriptions, string_agg_distinct
from bizlake.functions.time import as_of_ts, day, elapsed_days, fmt, in_zone_range, local_ts, ts_lit
from bizlake.operators.calendar import (
    SLA_END, SLA_HOLIDAYS, SLA_START, business_days_between, next_business_day, plan_sla_days, sla_due_date,
)
from bizlake.operators.changelog import error_episodes, first_promise, first_transition, has_text, log_of, unpack_changes
from bizlake.operators.cohort import company_plans
from bizlake.operators.hours import clock_hours, clock_hours_case, with_moments
from bizlake.operators.orders import late_for_client, late_for_operation, share_of_total
from bizlake.operators.ordered import sliced
from bizlake.operators.skew import with_missing
from bizlake.operators.status import status_pairs
from bizlake.operators.stock import (
    SHIPPED_CATEGORIES, alive, measure_fallback, order_measures, shipment_measures, shipped_quantity,
)
from bizlake.plans.common import DMY_DASH, YMD, articles, local_text, pick, up
from bizlake.sources.tables import Tables

# Fixed value: order states the queue report shows, in its order.
QUEUE = tuple(L.QUEUE_STATUS)


def _services(t: Tables) -> DataFrame:
    return pick(t.shipping_services, id="shipping_service_id", company_name="carrier", name="method")


def _companies(t: Tables) -> DataFrame:
    return pick(t.companies, id="company_id", name="company_name")


def _live_orders(t: Tables, *status_out: str) -> DataFrame:
    """Orders that are not deleted and not in a status, keyed for the shipments."""
    rows = alive(t.shipping_orders)
    if status_out:
        rows = rows.where(~F.col("status").isin(*status_out))
    return rows.withColumnsRenamed({"id": "shipping_order_id", "status": "order_status"}).drop("deleted_at")


def _sent(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Live shipments that leave the stock; of ``orders`` if given, which then meet them without moving them again."""
    rows = alive(t.shipments).where(F.col("shipment_category").isin(*SHIPPED_CATEGORIES))
    if orders is not None:
        rows = rows.join(orders.select("shipping_order_id"), "shipping_order_id", "left_semi")
    return rows.withColumnRenamed("id", "shipment_id").drop("deleted_at")


def _requesters(t: Tables, keep_unknown: bool) -> DataFrame:
    """Names of the followers of each order."""
    users = pick(t.users, id="follower_id", first_name="first_name", last_name="last_name")
    rows = t.shipping_orders_followers.join(users, "follower_id", "left" if keep_unknown else "inner")
    name = concat_skip_null(F.col("first_name"), " ", F.col("last_name"))
    return rows.groupBy("shipping_order_id").agg(string_agg_distinct(name).alias("requesters"))


def shipments_base(
    t: Tables, start: str = "2024-01-01", end: str = "2026-01-01", zone_mode: str = "utc_to_local"
) -> DataFrame:
    """Order x ship time: pieces, kits and calendar parts, for orders created in [start, end) local time.

    An order without shipments stays; a shipment that is deleted does not count.
    """
    created, shipped = local_ts("created_at", mode=zone_mode), local_ts("shipped_at", mode=zone_mode)
    if zone_mode == "utc_to_local":
        period = in_zone_range("created_at", start, end)
    else:
        period = (created >= ts_lit(start)) & (created < ts_lit(end))
    orders = t.shipping_orders.where(~F.col("status").isin("canceled", "draft") & period).select(
        F.col("id").alias("shipping_order_id"), "code", "created_at", "total_kits_quantity"
    )
    own = t.shipments.join(orders.select("shipping_order_id"), "shipping_order_id", "left_semi")
    pieces = shipped_quantity(alive(own), t.shipment_items).withColumnRenamed("quantity", "pieces")
    trips = own.select("shipping_order_id", "shipped_at", "deleted_at").distinct()
    rows = with_missing(trips, orders, ["shipping_order_id"]).where(F.col("deleted_at").isNull())
    rows = rows.join(orders, "shipping_order_id")
    rows = rows.join(pieces, "shipping_order_id", "left")
    grain = rows.select("code", "created_at", "shipped_at", "total_kits_quantity", "pieces").distinct()
    return grain.select(
        "code",
        fmt(created, YMD).alias("created_at"),
        fmt(shipped, YMD).alias("shipped_at"),
        "total_kits_quantity",
        F.col("pieces").alias("soma_quantidade_peças"),
        F.month(day(created)).alias("mês_created_at"),
        F.year(day(created)).alias("ano_created_at"),
        F.month(day(shipped)).alias("mês_shipped_at"),
        F.year(day(shipped)).alias("ano_shipped_at"),
        F.weekofyear(day(created)).alias("num_semana_created_at"),
    )


def shipments_detail(t: Tables, since: str = "2025-01-01") -> DataFrame:
    """Shipment: names, articles, price (declared value when there is no price), days to delivery.

    The price sum counts an article once per kit of the order, as the report always
    did; the kits enter as a weight, so rows are not multiplied.
    """
    orders = _live_orders(t, "CANCELED", "canceled").where(F.col("shipment_expected_to") >= ts_lit(since))
    kits = (
        t.shipping_orders_customer_kits.join(pick(t.customer_kits, id="customer_kit_id", name="kit"), "customer_kit_id", "left")
        .groupBy("shipping_order_id")
        .agg(string_agg_distinct("kit").alias("kits"), F.count("*").alias("kit_rows"))
    )
    heads = (
        orders.join(_companies(t), "company_id", "left")
        .join(pick(t.teams, id="team_id", name="team"), "team_id", "left")
        .join(kits, "shipping_order_id", "left")
        .join(_requesters(t, keep_unknown=True), "shipping_order_id", "left")
    )
    arrived = first_transition(t.versions, "Shipment", "DELIVERED").withColumnRenamed("item_id", "_log_id")
    sent = _sent(t, orders).withColumn("_log_id", F.col("shipment_id").cast("string"))
    kept = sent.select("shipment_id")
    parts = t.shipment_items.select("shipment_id", "customer_product_id", "quantity").join(kept, "shipment_id", "left_semi")
    totals = parts.groupBy("shipment_id").agg(F.sum("quantity").alias("pieces"))
    goods = articles(t).select("customer_product_id", "cp_sku", "cp_name", "p_name", "unit_price")
    lines = with_missing(parts.select("shipment_id", "customer_product_id"), kept, ["shipment_id"])
    rows = (
        lines.join(sent.join(heads, "shipping_order_id"), "shipment_id")
        .join(goods, "customer_product_id", "left")
        .join(arrived, "_log_id", "left")
        .join(totals, "shipment_id", "left")
        .join(_services(t), "shipping_service_id", "left")
    )
    weight = F.coalesce("kit_rows", F.lit(1))
    grain = [
        "code", "shipment_expected_to", "status", "company_name", "created_at", "title", "recipient_name",
        "recipient_zipcode", "recipient_state", "shipment_category", "carrier", "method", "shipment_price",
        "recipient_city", "shipping_purpose", "created_through", "team", "tracking_code", "requesters",
        "declared_value", "recipient_street", "recipient_number", "recipient_complement",
        "recipient_neighborhood", "service_bill_id", "recipient_document_number", "shipped_at", "reached_at",
    ]
    grouped = rows.groupBy(*grain).agg(
        F.max("kits").alias("kits"),
        string_agg_distinct("cp_sku").alias("skus"),
        string_agg_distinct(F.coalesce("p_name", "cp_name")).alias("names"),
        string_agg_distinct("shirt_size").alias("sizes"),
        F.sum(F.col("unit_price") * weight).alias("price"),
        F.max("pieces").alias("pieces"),
    )
    return grouped.select(
        F.col("code").alias("Pedido de Envio"),
        F.col("company_name").alias("Cliente"),
        F.col("requesters").alias("Solicitante"),
        F.col("team").alias("Time"),
        F.col("title").alias("Nome do Pedido de Envio"),
        F.col("recipient_name").alias("Destinatário"),
        F.col("tracking_code").alias("Código de Rastreio"),
        F.col("kits").alias("Kit do Cliente"),
        F.col("shipping_purpose").alias("Objetivo do Envio"),
        F.col("skus").alias("Skus"),
        F.col("names").alias("Nome Produtos"),
        F.col("sizes").alias("Tamanhos"),
        F.when(F.coalesce("price", F.lit(0)) == 0, F.col("declared_value")).otherwise(F.col("price")).alias("Preço"),
        F.col("shipment_price").alias("Frete"),
        F.col("recipient_city").alias("Cidade"),
        F.col("recipient_state").alias("Estado"),
        local_text("created_at", DMY_DASH).alias("Data da Solicitação"),
        local_text("shipment_expected_to", DMY_DASH).alias("Data do Envio"),
        local_text("shipment_expected_to", "MM").alias("Mês de Envio"),
        local_text("shipment_expected_to", "yyyy").alias("Ano de Envio"),
        F.col("status").alias("Status"),
        F.col("created_through").alias("Meio de Solicitação"),
        F.col("pieces").alias("Quantidade Total"),
        F.col("shipment_category").alias("Categoria de Envio"),
        F.col("carrier").alias("Transportadora"),
        F.col("method").alias("Método de Envio"),
        F.round(elapsed_days("shipped_at", "reached_at")).cast("int").alias("Tempo de Entrega em Dias"),
    ).orderBy(*up("Pedido de Envio", "Código de Rastreio"))


def shipping_type_sla(
    t: Tables,
    since: str = "2023-01-01",
    holidays=SLA_HOLIDAYS,
    start: date = SLA_START,
    end: date = SLA_END,
    zone_mode: str = "utc_to_local",
    strict: bool = False,
) -> DataFrame:
    """Order x type x ship date x SKU count: due dates, lateness, time in error, share of the kits.

    A company with several plans shows each of them. Error episodes are reduced to one
    row per order before the join, so they do not multiply the pieces. With ``strict`` they do: pieces count once per
    episode of the order, as the literal report has it; the episodes enter as a weight.
    """
    orders = t.shipping_orders.where(
        ~F.col("status").isin("canceled", "draft") & (F.col("created_at") > ts_lit(since))
    ).select(
        F.col("id").alias("shipping_order_id"), "code", "company_id", "created_through", "total_kits_quantity",
        local_ts("created_at", mode=zone_mode).alias("created_at"),
    )
    pieces = t.shipment_items.groupBy("shipment_id").agg(
        F.sum("quantity").alias("pieces"), F.count_distinct("customer_product_id").alias("sku_count")
    )
    trips = alive(t.shipments).where(F.col("shipped_at").isNotNull()).select(
        F.col("id").alias("shipment_id"), "shipping_order_id", local_ts("shipped_at", mode=zone_mode).alias("shipped_at")
    )
    promises = first_promise(t.versions).withColumnRenamed("item_id", "_log_id")
    trips = (
        trips.join(pieces, "shipment_id", "left")
        .withColumns({"sku_count": F.coalesce("sku_count", F.lit(0)), "_log_id": F.col("shipment_id").cast("string")})
        .join(promises, "_log_id", "left")
    )
    heads = orders.join(_companies(t), "company_id", "left").join(
        company_plans(t.subscriptions, t.plans), "company_id", "left"
    ).withColumn("plan_name", F.coalesce("plan_name", F.lit(L.NO_PLAN)))
    rows = trips.join(heads, "shipping_order_id").withColumns(
        {
            "kind": L.shipping_type("sku_count", "created_through"),
            "work_days": business_days_between("created_at", "shipped_at", holidays, start, end),
        }
    )
    rows = next_business_day(rows, "created_at", "_next_day", holidays, start, end)
    rows = sla_due_date(rows, "created_at", plan_sla_days("plan_name", "kind"), "due_operation", 18, holidays, start, end)
    due_client = F.coalesce(F.col("first_promise").cast("date"), F.col("_next_day"))
    sent_on = day("shipped_at")
    rows = rows.withColumns({"due_client": due_client, "sent_on": sent_on}).withColumns(
        {
            "late_client": late_for_client(F.col("sent_on"), F.col("due_client")),
            "late_operation": late_for_operation(F.col("sent_on"), F.col("due_client"), F.col("due_operation")),
        }
    )
    grouped = rows.groupBy(
        "code", "shipping_order_id", "plan_name", "company_name", "kind", "sent_on", "sku_count"
    ).agg(
        F.min("created_at").alias("created_at"),
        F.min("due_client").alias("due_client"),
        F.min("due_operation").alias("due_operation"),
        F.bool_or("late_client").alias("late_client"),
        F.bool_or("late_operation").alias("late_operation"),
        F.max("work_days").alias("work_days"),
        F.sum("pieces").alias("pieces"),
        F.max("total_kits_quantity").alias("kits"),
    )
    errors = (
        error_episodes(t.versions)
        .groupBy(F.col("item_id").alias("_log_id"))
        .agg(F.max("days").alias("error_days"), F.max("hours").alias("error_hours"), F.count("*").alias("episodes"))
    )
    known = grouped.withColumn("_log_id", F.col("shipping_order_id").cast("string")).join(errors, "_log_id", "left")
    if strict:
        known = known.withColumn("pieces", F.col("pieces") * F.coalesce("episodes", F.lit(1)))
    full = share_of_total(known, ["code"], "pieces", "kits", "kit_share", few_rows=True)
    created = day("created_at")
    return full.select(
        "code",
        "shipping_order_id",
        F.col("plan_name").alias("Plano"),
        F.col("company_name").alias("Cliente"),
        F.col("kind").alias("Tipo Envio"),
        fmt("created_at", DMY_DASH).alias("Criado em"),
        fmt("sent_on", DMY_DASH).alias("Saida Efetiva (Data do Envio)"),
        fmt("due_client", DMY_DASH).alias("Saida esperada Cliente (data)"),
        fmt("due_operation", DMY_DASH).alias("Saida Esperada Operação (data)"),
        L.sim_nao(F.col("late_client")).alias("Atraso visão cliente (sim/não)"),
        L.sim_nao(F.col("late_operation")).alias("Atraso visão operação (sim/não)"),
        F.col("work_days").alias("Dias (uteis) entre criação do pedido e envio"),
        F.month(created).alias("Mês de Criação"),
        F.year(created).alias("Ano de Criação"),
        F.month("sent_on").alias("Mês de Envio"),
        F.year("sent_on").alias("Ano de Envio"),
        F.weekofyear(created).alias("num_semana_created_at"),
        F.col("sku_count").alias("# SKUs"),
        F.col("pieces").alias("soma_pecas"),
        F.col("kit_share").alias("Kits enviados"),
        L.sim_nao(F.col("error_days").isNotNull()).alias("Teve erro"),
        F.col("error_days").alias("Tempo em erro (dias)"),
        F.col("error_hours").alias("Tempo em erro (horas)"),
    ).orderBy(*up("code", "Ano de Envio", "Mês de Envio", "Saida Efetiva (Data do Envio)"))


def shipping_status_times(
    t: Tables, since: str = "2024-01-02", item_type: str | None = "ShippingOrder", merge: bool = True
) -> DataFrame:
    """Status changes of shipping orders with their hours (variant 2).

    ``since`` is the first creation day. ``merge`` puts changes that happen at the same
    instants between the same statuses into one row with the list of order codes.
    """
    orders = t.shipping_orders.where(F.col("created_at") >= ts_lit(since)).select(
        F.col("id").cast("string").alias("item_id"), "code"
    )
    log = t.versions if item_type is None else log_of(t.versions, item_type)
    log = sliced(log, ["item_id"], ["created_at"])
    events = unpack_changes(log, "status", keep=["_slice"]).select(
        "item_id", F.col("created_at").alias("at"), "_slice", F.col("value").alias("status")
    ).where(has_text(F.col("status")))
    # Orders meet the log on the key the pairs need anyway, so one shuffle serves both.
    changes = status_pairs(events.join(orders, "item_id"), "item_id")
    changes, (start, end) = with_moments(changes, "previous_at", "current_at")
    changes = changes.withColumns(
        {
            "event_month_year": fmt("previous_at", "yyyy-MM"),
            "hours_between_status_case": clock_hours_case(start, end),
            "hours": clock_hours(start, end),
        }
    )
    grain = ["event_month_year", "previous_status", "current_status", "previous_at", "current_at", "hours_between_status_case"]
    grouped = changes.groupBy(*grain, *([] if merge else ["item_id"])).agg(
        string_agg_distinct("code").alias("codes"), F.avg("hours").alias("avg_hours_between_status")
    )
    before = L.map_labels("previous_status", L.SHIPPING_ORDER_STATUS)
    after = L.map_labels("current_status", L.SHIPPING_ORDER_STATUS)
    return grouped.select(
        "event_month_year",
        "codes",
        before.alias("previous_status"),
        after.alias("current_status"),
        concat_skip_null(before, "->", after).alias("variacao_status"),
        F.col("previous_at").alias("previous_created_at"),
        F.col("current_at").alias("current_created_at"),
        "hours_between_status_case",
        "avg_hours_between_status",
    ).orderBy(*up("codes", "previous_created_at", "current_created_at"))


def shipping_queue(t: Tables, as_of=None, zone_mode: str = "utc_to_local") -> DataFrame:
    """Open orders with queue status, pieces, value, SKU count and age."""
    orders = t.shipping_orders.where(
        F.col("status").isin(*QUEUE) & F.col("shipment_expected_to").isNotNull()
    ).select(
        "id", "code", "company_id", "status", "assembly_type", "total_kits_quantity", "created_at", "shipment_expected_to"
    )
    measured = measure_fallback(
        orders,
        shipment_measures(t.shipments, t.shipment_items, t.customer_products),
        order_measures(t.shipping_orders, t.shipping_order_items, t.customer_products),
    )
    rows = measured.join(_companies(t), "company_id", "left")
    # The distinct rows of the report's own grain: an order id is not part of it.
    rows = rows.drop("id", "company_id").distinct()
    rank = L.priority("status", QUEUE)
    rows = rows.orderBy(*up(F.least(rank, F.lit(10)), "shipment_expected_to", "code"))
    return rows.select(
        "code",
        local_text("created_at", YMD, zone_mode).alias("created_at"),
        local_text("shipment_expected_to", YMD, zone_mode).alias("data_esperada_de_saída"),
        L.map_labels("status", L.QUEUE_STATUS).alias("status"),
        "company_name",
        F.col("total_kits_quantity").alias("montagem"),
        L.map_labels("assembly_type", L.ASSEMBLY_TYPE, "desconhecido").alias("pedidos"),
        "total_skus",
        F.col("total_value").alias("total_valor_envio"),
        "total_quantity",
        L.age_bucket("shipment_expected_to", as_of).alias("tempo_de_processo"),
    )


def shipments_finance(t: Tables, since: str = "2025-01-01", zone_mode: str = "utc_to_local") -> DataFrame:
    """Company x SKU x ship time x sale: pieces, carriers, methods and orders.

    A shipping order tied to several sales counts its pieces under each of them.
    """
    orders = _live_orders(t, "canceled").select("shipping_order_id", "code", "company_id", "created_at")
    linked = t.shipping_order_sales.join(pick(t.sales, id="sale_id", code="sale_code"), "sale_id", "left").select(
        "shipping_order_id", "sale_code"
    )
    goods = articles(t).select("customer_product_id", "cp_sku", F.coalesce("p_name", "cp_name").alias("name"))
    sent = _sent(t).where(F.col("shipped_at") >= ts_lit(since)).select(
        "shipment_id", "shipping_order_id", "shipping_service_id", "shipped_at", "status"
    )
    rows = (
        with_missing(t.shipment_items, sent, ["shipment_id"])
        .join(sent.join(orders, "shipping_order_id"), "shipment_id")
        .join(goods, "customer_product_id", "left")
        .join(_services(t), "shipping_service_id", "left")
        .join(_companies(t), "company_id", "left")
        .join(with_missing(linked, orders, ["shipping_order_id"]), "shipping_order_id")
    )
    grain = ["company_name", "cp_sku", "shipped_at", "created_at", "status", "sale_code"]
    grouped = rows.groupBy(*grain).agg(
        string_agg_distinct("name").alias("names"),
        F.sum("quantity").alias("pieces"),
        string_agg_distinct("carrier").alias("carriers"),
        string_agg_distinct("method").alias("methods"),
        string_agg_distinct("code").alias("codes"),
    )
    return grouped.orderBy(*up("company_name", "cp_sku", "shipped_at", "sale_code")).select(
        F.col("company_name").alias("Empresa"),
        F.col("cp_sku").alias("SKU"),
        local_text("shipped_at", DMY_DASH, zone_mode).alias("Data do Envio"),
        local_text("created_at", DMY_DASH, zone_mode).alias("Data da Solicitação de Envio"),
        F.col("names").alias("Nome Produtos"),
        F.col("pieces").alias("Quantidade Total"),
        F.col("carriers").alias("Transportadoras"),
        F.col("methods").alias("Métodos de Envio"),
        F.col("codes").alias("Pedidos de Envio"),
        F.col("status").alias("Status do Envio"),
        F.col("sale_code").alias("Código da Venda"),
    )


def orders_vs_finance(t: Tables, since: str = "2024-01-01", zone_mode: str = "utc_to_local") -> DataFrame:
    """Shipment: requesters, articles, handled pieces and billing key."""
    orders = _live_orders(t, "canceled").where(F.col("shipment_expected_to") >= ts_lit(since))
    heads = (
        orders.join(_companies(t), "company_id", "left")
        .join(pick(t.teams, id="team_id", name="team"), "team_id", "left")
        .join(_requesters(t, keep_unknown=False), "shipping_order_id", "left")
    )
    goods = articles(t).select(
        "customer_product_id", "cp_sku", F.coalesce("p_name", "cp_name").alias("name"), "unit_price"
    )
    sent = _sent(t, orders)
    kept = sent.select("shipment_id")
    parts = t.shipment_items.join(kept, "shipment_id", "left_semi")
    rows = (
        with_missing(parts, kept, ["shipment_id"])
        .join(sent.join(heads, "shipping_order_id"), "shipment_id")
        .join(goods, "customer_product_id", "left")
        .join(_services(t), "shipping_service_id", "left")
    )
    handled = F.when(F.col("assembly_type") != "loose_items", F.col("quantity")).otherwise(F.lit(0))
    grain = [
        "shipping_order_id", "code", "shipment_expected_to", "status", "company_name", "created_at", "title",
        "recipient_name", "recipient_zipcode", "recipient_state", "shipment_category", "carrier", "method",
        "shipment_price", "recipient_city", "shipping_purpose", "created_through", "team", "tracking_code",
        "service_bill_id",
    ]
    grouped = rows.groupBy(*grain).agg(
        F.max("requesters").alias("requesters"),
        string_agg_distinct("cp_sku").alias("skus"),
        string_agg_distinct("name").alias("names"),
        string_agg_distinct("shirt_size").alias("sizes"),
        F.sum("unit_price").alias("price"),
        F.sum("quantity").alias("pieces"),
        F.sum(handled).alias("handled"),
        F.max("days_to_deliver").alias("days_to_deliver"),
    )
    return grouped.select(
        F.col("code").alias("Pedido de Envio"),
        F.col("company_name").alias("Cliente"),
        F.col("requesters").alias("Solicitante"),
        F.col("team").alias("Time"),
        F.col("title").alias("Nome do Pedido de Envio"),
        F.col("recipient_name").alias("Destinatário"),
        F.col("tracking_code").alias("Código de Rastreio"),
        F.col("shipping_purpose").alias("Objetivo do Envio"),
        F.col("skus").alias("Skus"),
        F.col("names").alias("Nome Produtos"),
        F.col("sizes").alias("Tamanhos"),
        F.col("price").alias("Preço"),
        F.col("shipment_price").alias("Frete"),
        F.col("recipient_city").alias("Cidade"),
        F.col("recipient_state").alias("Estado"),
        local_text("created_at", DMY_DASH, zone_mode).alias("Data da Solicitação"),
        local_text("shipment_expected_to", DMY_DASH, zone_mode).alias("Data do Envio"),
        F.col("status").alias("Status"),
        F.col("created_through").alias("Meio de Solicitação"),
        F.col("pieces").alias("Quantidade Total"),
        F.col("handled").alias("Quantidade Manuseada"),
        F.col("recipient_zipcode").alias("Endereço"),
        F.col("shipment_category").alias("Categoria de Envio"),
        F.col("carrier").alias("Transportadora"),
        F.col("method").alias("Método de Envio"),
        F.col("days_to_deliver").alias("Dias para Entrega"),
        "service_bill_id",
    ).orderBy(*up("Pedido de Envio", "Código de Rastreio"))


def returns(
    t: Tables, as_of=None, days: int = 1, pattern: str = "%Objeto não entregue%", zone_mode: str = "utc_to_local", strict: bool = False
) -> DataFrame:
    """Returned or diverted shipments changed within the last ``days``.

    Cancelled orders are left out in either letter case; with ``strict`` only where the status is in capitals.

    Sums count an item once per kit and follower of its order, as the report always
    did; kits and followers enter as weights, so rows are not multiplied. Both sides of
    the time test shift by the same zone, so it runs on the stored UTC column.
    """
    running = F.col("status") != "CANCELED" if strict else F.lower("status") != "canceled"
    orders = t.shipping_orders.where(running).select(
        F.col("id").alias("shipping_order_id"), "code", "title", "company_id", "shipment_expected_to", "created_at"
    )
    kits = (
        t.shipping_orders_customer_kits.join(pick(t.customer_kits, id="customer_kit_id", name="kit"), "customer_kit_id", "left")
        .groupBy("shipping_order_id").agg(string_agg_distinct("kit").alias("kits"), F.count("*").alias("kit_rows"))
    )
    users = pick(t.users, id="follower_id", first_name="first_name", last_name="last_name", email="email")
    followers = (
        t.shipping_orders_followers.join(users, "follower_id", "left")
        .groupBy("shipping_order_id")
        .agg(
            string_agg_distinct(concat_skip_null(F.col("first_name"), " ", F.col("last_name"))).alias("requesters"),
            string_agg_distinct("email").alias("emails"),
            F.count("*").alias("follower_rows"),
        )
    )
    firms = pick(t.companies, id="company_id", name="company_name", financial_email="financial_email")
    heads = (
        orders.join(firms, "company_id", "left")
        .join(kits, "shipping_order_id", "left")
        .join(followers, "shipping_order_id", "left")
    )
    since = as_of_ts(as_of) - F.expr(f"INTERVAL '{days}' DAY")
    sent = alive(t.shipments).where(
        F.col("status").isin("PACKAGE_RETURNED", "DEVIATION") & (F.col("updated_at") >= since)
    ).withColumnRenamed("id", "shipment_id")
    goods = articles(t).select("customer_product_id", "cp_sku", "p_name", "unit_price")
    lines = (
        t.shipment_items.join(sent.select("shipment_id"), "shipment_id", "left_semi")
        .join(goods, "customer_product_id", "left")
        .groupBy("shipment_id")
        .agg(
            string_agg_distinct("cp_sku").alias("skus"),
            string_agg_distinct("p_name").alias("names"),
            F.sum("quantity").alias("pieces"),
            F.sum(F.col("unit_price") * F.col("quantity")).alias("cost"),
        )
    )
    weight = F.coalesce("kit_rows", F.lit(1)) * F.coalesce("follower_rows", F.lit(1))
    rows = (
        sent.join(heads, "shipping_order_id")
        .join(_services(t), "shipping_service_id", "left")
        .join(lines, "shipment_id", "left")
    )
    return rows.orderBy(*up("code", "shipment_id")).select(
        F.col("company_name").alias("Cliente"),
        F.col("financial_email").alias("E-mail do Cliente"),
        F.col("code").alias("Número do Pedido de Envio"),
        F.col("title").alias("Nome do Pedido de Envio"),
        # An order without followers still shows the blank between two empty names.
        F.coalesce("requesters", F.lit(" ")).alias("Solicitante"),
        F.col("emails").alias("E-mail do Solicitante"),
        F.col("recipient_name").alias("Destinatário"),
        F.col("recipient_document_number").alias("CPF/CNPJ Destinatário"),
        F.col("recipient_zipcode").alias("CEP"),
        F.col("recipient_street").alias("Logradouro"),
        F.col("recipient_number").alias("Número"),
        F.col("recipient_complement").alias("Complemento"),
        F.col("recipient_neighborhood").alias("Bairro"),
        F.col("recipient_city").alias("Cidade"),
        F.col("recipient_state").alias("Estado"),
        F.col("recipient_email").alias("E-mail do Destinatário"),
        F.col("skus").alias("SKUs"),
        F.col("names").alias("Nome dos Produtos"),
        F.col("shirt_size").alias("Tamanhos de Camiseta"),
        F.col("kits").alias("Kit do Cliente"),
        (F.col("pieces") * weight).alias("Quantidade Total de Itens"),
        (F.col("cost") * weight).alias("Custo dos Produtos"),
        F.col("shipment_price").alias("Frete"),
        local_text("shipment_expected_to", DMY_DASH, zone_mode).alias("Data do Envio"),
        F.col("status").alias("Status"),
        F.col("shipment_category").alias("Categoria de Envio"),
        F.col("carrier").alias("Transportadora"),
        F.col("method").alias("Método de Envio"),
        F.col("days_to_deliver").alias("Dias para Entrega"),
        matching_descriptions("tracking_events", pattern).alias("Motivo da Devolução"),
        F.col("tracking_code").alias("Código de Rastreio"),
    )
