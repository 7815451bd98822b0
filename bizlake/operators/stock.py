"""Stock levels, turnover, origin, receipts and order measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.functions.time import as_of_ts, month_start
from bizlake.operators.skew import with_missing

# Shipment categories that leave the stock, and move types by origin.
SHIPPED_CATEGORIES = ("SHIPPING", "DEVOLUTION_RESEND")
BOUGHT_MOVES = ("RECEIPT", "picking")
GIVEN_MOVES = ("manual_input", "customer_input")
RECEIPT_MOVES = ("RECEIPT", "customer_input")


def alive(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("deleted_at").isNull())


def stock_quantity(sized: Column, sized_amount: Column, plain_amount: Column) -> Column:
    """Stock of a size row when there is one, else of the article itself."""
    return F.when(sized, F.coalesce(sized_amount, F.lit(0))).otherwise(F.coalesce(plain_amount, F.lit(0)))


def company_stock(customer_products: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pieces in stock per company, over articles or sizes that have any."""
    s = sizes.select(
        F.col("customer_product_id").alias("id"), F.col("id").alias("size_id"), "inventory_amount"
    )
    own = customer_products.select("id", "company_id", "unique_inventory_amount")
    rows = with_missing(s, own, ["id"]).join(own, "id")
    some = (F.col("unique_inventory_amount") > 0) | (F.col("inventory_amount") > 0)
    amount = stock_quantity(F.col("size_id").isNotNull(), F.col("inventory_amount"), F.col("unique_inventory_amount"))
    return (
        rows.where(some & F.col("company_id").isNotNull())
        .groupBy("company_id")
        .agg(F.sum(amount).alias("stock"))
    )


def shipped_quantity(shipments: DataFrame, shipment_items: DataFrame) -> DataFrame:
    """Pieces per shipping order of the given ``shipments``; other shipments' items are not summed."""
    live = shipments.select(F.col("id").alias("shipment_id"), "shipping_order_id")
    return (
        shipment_items.select("shipment_id", "quantity")
        .join(live, "shipment_id")
        .groupBy("shipping_order_id")
        .agg(F.sum("quantity").alias("quantity"))
    )


def monthly_consumption(
    shipping_orders: DataFrame, shipments: DataFrame, shipment_items: DataFrame, as_of=None, months: int = 12
) -> DataFrame:
    """Shipped pieces over the months that had shipments, per company, in the last ``months``."""
    since = as_of_ts(as_of) - F.expr(f"INTERVAL '{months}' MONTH")
    orders = alive(shipping_orders).where(
        (F.col("created_at") >= since) & (F.col("status") != "canceled")
    ).select(F.col("id").alias("shipping_order_id"), "company_id", month_start("created_at").alias("month"))
    sent = alive(shipments).where(F.col("shipment_category").isin(*SHIPPED_CATEGORIES))
    sent = sent.join(orders.select("shipping_order_id"), "shipping_order_id", "left_semi")
    rows = orders.join(shipped_quantity(sent, shipment_items), "shipping_order_id")
    per_month = rows.groupBy("company_id", "month").agg(F.sum("quantity").alias("quantity"))
    total = per_month.groupBy("company_id").agg(
        F.sum("quantity").alias("shipped"), F.count("month").alias("active_months")
    )
    mean = F.round(F.col("shipped").cast("decimal(18,0)") / F.col("active_months"), 2).cast("decimal(18,2)")
    return total.withColumn("monthly_mean", mean)


def stock_turnover(stock: DataFrame, consumption: DataFrame) -> DataFrame:
    """Months the stock lasts at the mean monthly consumption; NULL without consumption."""
    months = F.round(F.col("stock").cast("decimal(18,0)") / F.col("monthly_mean"), 1).cast("decimal(18,1)")
    return stock.join(consumption, "company_id", "left").withColumn(
        "turnover", F.when(F.col("monthly_mean") > 0, months)
    )


def stock_origin(
    customer_products: DataFrame,
    moves: DataFrame,
    items: DataFrame,
    bought: str,
    given: str = "Recebido diretamente do cliente",
    unknown: str = "Desconhecido",
) -> DataFrame:
    """Where each customer article came from, by the kinds of moves and sales it has.

    Moves and sale items are reduced to one row per article before the joins.
    """
    flags = (
        moves.where(F.col("operation_type").isin(*BOUGHT_MOVES, *GIVEN_MOVES))
        .groupBy(F.col("customer_product_id").alias("id"))
        .agg(
            F.bool_or(F.col("operation_type").isin(*BOUGHT_MOVES)).alias("_in"),
            F.bool_or(F.col("operation_type").isin(*GIVEN_MOVES)).alias("_given"),
        )
    )
    sold = items.select(F.col("customer_product_id").alias("id")).dropna().distinct().withColumn("_sold", F.lit(True))
    rows = customer_products.select("id").join(flags, "id", "left").join(sold, "id", "left")
    origin = origin_label(F.col("_in"), F.col("_given"), F.col("_sold"), bought, given, unknown)
    return rows.select(F.col("id").alias("customer_product_id"), origin.alias("origin"))


def origin_label(
    moved_in: Column, moved_given: Column, sold: Column, bought: str,
    given: str = "Recebido diretamente do cliente", unknown: str = "Desconhecido",
) -> Column:
    """Origin of an article from three tests, of which NULL means no."""
    is_in, is_given, is_sold = (F.coalesce(c, F.lit(False)) for c in (moved_in, moved_given, sold))
    return F.when(is_in & is_sold, bought).when(is_given | ~is_sold, given).otherwise(unknown)


def article_moves(moves: DataFrame) -> DataFrame:
    """One row per article from one pass over the moves: origin tests, moved pieces, and moved pieces by size.

    Moves are summed by article and size first, which also spreads an article with very many moves; what is then
    brought together for an article is one row per size.
    """
    by_size = moves.groupBy("customer_product_id", "variant_id").agg(
        F.sum("quantity").alias("_moved"),
        F.bool_or(F.col("operation_type").isin(*BOUGHT_MOVES)).alias("_in"),
        F.bool_or(F.col("operation_type").isin(*GIVEN_MOVES)).alias("_given"),
    )
    sized = F.when(F.col("variant_id").isNotNull(), F.struct("variant_id", "_moved"))
    return by_size.groupBy("customer_product_id").agg(
        F.bool_or("_in").alias("moved_in"), F.bool_or("_given").alias("moved_given"), F.sum("_moved").alias("moved_all"),
        F.map_from_entries(F.collect_list(sized)).alias("moved_by_size"),
    )


def child_quantity(moves: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Expected pieces of the child moves of each parent move."""
    rows = moves.where(F.col("operation_type").isin(*RECEIPT_MOVES) & ~F.col("status").isin(*excluded))
    return (
        rows.where(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("id"))
        .agg(F.sum("expected_quantity").alias("child_quantity"))
    )


def receipt_qty(moves: DataFrame, receipts: DataFrame, excluded: Sequence[str] = ("CANCELED",)) -> DataFrame:
    """Received pieces: sum over the children, else the move's own quantity, else the expected one."""
    rows = receipts.join(child_quantity(moves, excluded), "id", "left")
    return rows.withColumn(
        "received", F.coalesce("child_quantity", "quantity", "expected_quantity")
    ).drop("child_quantity")


def shipment_measures(shipments: DataFrame, shipment_items: DataFrame, articles: DataFrame) -> DataFrame:
    """Pieces, value and number of SKUs per shipping order, from its live shipments."""
    sent = alive(shipments).select(F.col("id").alias("shipment_id"), "shipping_order_id")
    rows = shipment_items.select("shipment_id", "customer_product_id", F.coalesce("quantity", F.lit(0)).alias("quantity"))
    return _measures(rows.join(sent, "shipment_id"), articles)


def order_measures(shipping_orders: DataFrame, order_items: DataFrame, articles: DataFrame) -> DataFrame:
    """The same measures from the ordered items times the number of kits."""
    kits = shipping_orders.select(
        F.col("id").alias("shipping_order_id"), F.coalesce("total_kits_quantity", F.lit(1)).alias("kits")
    )
    rows = order_items.join(kits, "shipping_order_id", "left").select(
        "shipping_order_id",
        "customer_product_id",
        (F.coalesce("quantity", F.lit(0)) * F.coalesce("kits", F.lit(1))).alias("quantity"),
    )
    return _measures(rows, articles)


def _measures(rows: DataFrame, articles: DataFrame) -> DataFrame:
    prices = articles.select(F.col("id").alias("customer_product_id"), "sku", "unit_price")
    per_article = rows.groupBy("shipping_order_id", "customer_product_id").agg(F.sum("quantity").alias("quantity"))
    return (
        per_article.join(prices, "customer_product_id", "left")
        .groupBy("shipping_order_id")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum(F.coalesce("unit_price", F.lit(0)) * F.col("quantity")).alias("value"),
            F.count_distinct("sku").alias("skus"),
        )
    )


def measure_fallback(orders: DataFrame, shipped: DataFrame, ordered: DataFrame) -> DataFrame:
    """Measures of the shipments, else of the order's items, else 0."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"_{prefix}_{c}" for c in ("quantity", "value", "skus")}).withColumnRenamed(
            "shipping_order_id", "id"
        )

    rows = orders.join(named(shipped, "s"), "id", "left").join(named(ordered, "o"), "id", "left")
    picked = {
        f"total_{c}": F.coalesce(f"_s_{c}", f"_o_{c}", F.lit(0)) for c in ("quantity", "value", "skus")
    }
    return rows.withColumns(picked).drop(*[f"_{p}_{c}" for p in "so" for c in ("quantity", "value", "skus")])
