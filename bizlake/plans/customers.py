"""Customer, user and stock reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.functions.text import concat_skip_null
from bizlake.functions.time import as_of_ts, day_start, fmt, week_label
from bizlake.functions import labels as L
from bizlake.operators.cohort import cohort_first
from bizlake.operators.keys import first_per_key, latest_purchase, latest_subscription
from bizlake.operators.orders import customer_revenue
from bizlake.operators.skew import with_missing
from bizlake.operators.stock import (
    SHIPPED_CATEGORIES, alive, article_moves, company_stock, monthly_consumption, origin_label, stock_quantity,
    stock_turnover,
)
from bizlake.operators.usage import active_usage
from bizlake.plans.common import ADMIN_URL, DMY_SLASH, HOUSE, articles, pick, up
from bizlake.sources.tables import Tables

NO_SIZE = "Sem tamanho"


def customer_success(
    t: Tables, as_of=None, years: tuple[int, int] = (2024, 2025), admin_url: str = ADMIN_URL
) -> DataFrame:
    """Company: last purchase, plan, revenue per year and in total, ticket, last shipment, stock, turnover."""
    firms = pick(t.companies, id="company_id", name="company_name")
    last = pick(
        latest_purchase(t.sales), company_id="company_id", id="last_sale", order_date="last_date", total_price="last_value"
    )
    sent = t.shipping_orders.groupBy("company_id").agg(F.max("created_at").alias("last_shipped"))
    use = monthly_consumption(t.shipping_orders, t.shipments, t.shipment_items, as_of)
    turnover = stock_turnover(company_stock(t.customer_products, t.customer_product_sizes), use)
    rows = firms
    for part in (
        last,
        latest_subscription(t.sales, t.subscriptions, t.plans),
        customer_revenue(t.sales, years),
        sent,
        turnover.select("company_id", "stock", "turnover"),
    ):
        rows = rows.join(part, "company_id", "left")
    return rows.select(
        F.col("company_name").alias("Cliente"),
        F.col("plan_name").alias("Plano"),
        fmt("last_date", DMY_SLASH).alias("Data Última Compra"),
        F.col("last_value").alias("Valor Última Compra"),
        F.concat(F.lit(admin_url), F.col("last_sale").cast("string")).alias("Link Última Compra"),
        *[F.col(f"revenue_{y}").alias(f"Receita {y}") for y in years],
        F.col("revenue_total").alias("Receita Total"),
        F.col("orders").alias("Quant. Compras"),
        F.col("mean_ticket").alias("Ticket Médio"),
        fmt("last_shipped", DMY_SLASH).alias("Data Último Envio"),
        F.col("stock").alias("Estoque"),
        F.col("turnover").alias("Giro"),
    ).orderBy(*up("Cliente"))


def customer_credit(t: Tables) -> DataFrame:
    """Companies with a positive credit balance."""
    return t.companies.where(F.col("credit_balance") > 0).select("name", "credit_balance").orderBy(*up("credit_balance", "name"))


def user_directory(t: Tables) -> DataFrame:
    """User with company and plan; once per subscription of the company."""
    named = pick(t.plans, id="plan_id", name="plan_name")
    plans = t.subscriptions.select("company_id", "plan_id").join(named, "plan_id", "left")
    firms = pick(t.companies, id="company_id", name="company_name")
    # A user whose company is unknown gets no plan either.
    heads = firms.join(plans, "company_id", "left")
    return t.users.join(heads, "company_id", "left").select(
        concat_skip_null(F.col("first_name"), " ", F.col("last_name")).alias("Nome"),
        F.col("company_name").alias("Empresa"),
        F.col("plan_name").alias("Plano"),
        F.col("job_position").alias("Posição"),
        F.col("email").alias("Email"),
        F.col("phone").alias("Telefone"),
    )


def active_usage_report(t: Tables, since: str = "2025-05-01") -> DataFrame:
    """User x month x week: sign-ins, with the plan and head-count band of buying companies.

    A company that bought under several plans shows each of them.
    """
    use = active_usage(t.versions, since)
    users = t.users.select(F.col("id").cast("string").alias("item_id"), "company_id", F.col("email").alias("usuario"))
    firms = pick(t.companies, id="company_id", name="empresa")
    first = cohort_first(t.sales, t.companies, t.subscriptions, t.plans).select(
        "company_id", F.col("plan_name").alias("plano"), "employee_range"
    )
    rows = use.join(users, "item_id").join(firms, "company_id").join(first, "company_id", "left")
    return rows.select(
        "empresa",
        "usuario",
        F.col("month").alias("mes_data"),
        fmt("month", "MM/yyyy").alias("mes_formatado"),
        F.col("week").alias("semana_data"),
        week_label("week").alias("semana_formatada"),
        F.coalesce("plano", F.lit(L.NO_PLAN)).alias("plano"),
        "employee_range",
        F.col("accesses").alias("quantidade_de_acessos"),
        F.col("accesses_in_week").alias("acessos_na_semana"),
    ).orderBy(*up("semana_data", "empresa", "usuario", "mes_data", "plano"))


def stock_report(t: Tables, as_of=None, days: int = 90, house: str = HOUSE) -> DataFrame:
    """Customer article x size x sale: stock, value, origin, moved pieces, pieces shipped lately.

    Stock counts an article once per sale item of the same sale, as the report always did;
    the items enter as a weight per sale. ``house`` names the seller in the origin label.
    """
    firms = pick(t.companies, id="owner_id", name="company_name")
    teams = first_per_key(t.teams.select("company_id", "name"), ["company_id"], ["name"])
    teams = pick(teams, company_id="owner_id", name="team_name")
    sizes = pick(t.customer_product_sizes, id="size_id", customer_product_id="customer_product_id", name="size_name", inventory_amount="size_amount")
    ranges = first_per_key(
        t.pricing_ranges.where(F.col("units") >= 50).select("product_id", "units", "product_cost", "markup"),
        ["product_id"], ["units"],
    ).select("product_id", (F.col("product_cost") * F.col("markup")).alias("list_price"))
    per_sale = (
        t.sale_items.where(F.col("customer_product_id").isNotNull())
        .groupBy("customer_product_id", "sale_id").agg(F.count("*").alias("items"))
        .join(pick(t.sales, id="sale_id", code="sale_code"), "sale_id", "left")
        .groupBy("customer_product_id", "sale_code").agg(F.sum("items").alias("items"))
    )
    placed = t.customer_products_inventory_addresses.select("customer_product_id").distinct().withColumn("_placed", F.lit(True))
    # one pass over the moves for the origin and both moved quantities
    moves = article_moves(t.inventory_moves)

    cutoff = day_start(as_of_ts(as_of)) - F.expr(f"INTERVAL '{days}' DAY")
    orders = alive(t.shipping_orders).where(
        (F.col("status") != "canceled") & (F.col("shipment_expected_to") >= cutoff)
    ).select(F.col("id").alias("shipping_order_id"), F.col("company_id").alias("owner_id"))
    sent = alive(t.shipments).where(F.col("shipment_category").isin(*SHIPPED_CATEGORIES)).select(
        F.col("id").alias("shipment_id"), "shipping_order_id", F.coalesce("shirt_size", F.lit(NO_SIZE)).alias("_size")
    )
    own = pick(t.customer_products, id="customer_product_id", sku="_sku")
    article_ids = own.select("customer_product_id")
    shipped = (
        t.shipment_items.join(sent.join(orders, "shipping_order_id"), "shipment_id")
        .join(firms, "owner_id")
        .join(own, "customer_product_id")
        .groupBy("company_name", "_sku", "_size")
        .agg(F.sum("quantity").alias("shipped"))
    )
    amount = stock_quantity(F.col("size_id").isNotNull(), F.col("size_amount"), F.col("unique_inventory_amount"))
    rows = (
        articles(t)
        .join(sizes, "customer_product_id", "left")  # an article has few sizes
        .join(ranges, "product_id", "left")
        .join(firms, "owner_id", "left")
        .join(teams, "owner_id", "left")
        .withColumns({"_sku": F.coalesce("p_sku", "cp_sku"), "_size": F.coalesce("size_name", F.lit(NO_SIZE))})
        .join(shipped, ["company_name", "_sku", "_size"], "left")
        .where(
            (F.coalesce("unique_inventory_amount", F.lit(0)) > 0)
            | (F.coalesce("size_amount", F.lit(0)) > 0)
            | (F.coalesce("shipped", F.lit(0)) > 0)
        )
        .join(with_missing(per_sale, article_ids, ["customer_product_id"]), "customer_product_id")
        .join(placed, "customer_product_id", "left")
        .join(moves, "customer_product_id", "left")
    )
    weighted = amount * F.coalesce("items", F.lit(1))
    price = F.coalesce("unit_price", "list_price", F.lit(0))
    moved = F.when(F.col("size_id").isNull(), F.col("moved_all")).otherwise(F.try_element_at("moved_by_size", F.col("size_id")))
    # an article is sold if it has a row of sales
    origin = origin_label(F.col("moved_in"), F.col("moved_given"), F.col("items").isNotNull(), f"Comprado via {house}")
    ncm = F.coalesce("p_ncm", "cp_ncm")
    return rows.orderBy(*up("company_name", "team_name", "sale_code", F.coalesce("p_name", "cp_name"), "customer_product_id")).select(
        F.col("company_name").alias("Cliente"),
        F.col("team_name").alias("Time"),
        F.col("sale_code").alias("Pedido"),
        F.col("category_name").alias("Categoria"),
        F.coalesce("p_name", "cp_name").alias("Nome"),
        F.col("_sku").alias("SKU"),
        F.when(ncm != ".", ncm).alias("NCM"),
        F.col("_size").alias("Tamanho"),
        F.greatest(F.lit(0), weighted).alias("Estoque"),
        F.greatest(F.lit(0), weighted * price).alias("Valor Estoque (R$)"),
        origin.alias("Origem"),
        F.coalesce(moved, F.lit(0)).alias("Quantidade Movimentada"),
        F.coalesce("shipped", F.lit(0)).alias("Envios 90 dias"),
        F.when(F.col("_placed"), "Endereçado").otherwise("Não Endereçado").alias("Endereçado"),
    )
