"""Order-total allocation, volume bands and price grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.functions.time import col

# The volume bands of the price table.
VOLUME_BANDS = (50, 100, 250, 500, 1000)
GRID_BANDS = (50, 100, 1000)
CANCELED = "CANCELED"


def live_lines(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Sale lines that are not cancelled on orders that are not cancelled (NULL status drops)."""
    orders = sales.where(F.col("status") != CANCELED).select(
        F.col("id").alias("sale_id"), "code", "total_price"
    )
    lines = items.where(F.col("status") != CANCELED).select("sale_id", "amount", "final_price")
    return lines.join(orders, "sale_id")


def alloc_factor(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Order total over the sum of its line values, per order; 1 when that sum is not positive.

    Only lines of the given ``sales`` are summed, so pass the orders that are wanted.
    """
    orders = sales.where(F.col("status") != CANCELED).select(
        F.col("id").alias("sale_id"), "code", "total_price"
    )
    lines = (
        items.where(F.col("status") != CANCELED)
        .join(orders.select("sale_id"), "sale_id", "left_semi")
        .groupBy("sale_id")
        .agg(F.sum(F.col("amount") * F.col("final_price")).alias("line_total"))
    )
    factor = F.when(F.col("line_total") <= 0, F.lit(1.0)).otherwise(
        F.col("total_price").cast("double") / F.col("line_total").cast("double")
    )
    return orders.join(lines, "sale_id").withColumn("factor", factor)


def allocate(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with their value scaled so that each order adds up to its total."""
    factors = alloc_factor(sales, items).select("sale_id", "factor")
    value = (F.col("amount") * F.col("final_price")).cast("double")
    return items.join(factors, "sale_id", "left").withColumns(
        {"line_value": value, "allocated_value": value * F.col("factor")}
    )


def volume_band(c: str | Column, bands: Sequence[int] = VOLUME_BANDS) -> Column:
    """The band a quantity is priced in; above the last edge, or NULL, it is the last band."""
    value = col(c)
    chain = F
    for band in bands[:-1]:
        chain = chain.when(value <= band, F.lit(band))
    return chain.otherwise(F.lit(bands[-1]))


def band_lookup(
    lines: DataFrame, prices: DataFrame, amount: str = "amount", bands: Sequence[int] = VOLUME_BANDS
) -> DataFrame:
    """Lines with the price row of their product and volume band (NULLs where there is none)."""
    table = prices.select("product_id", F.col("units").alias("band"), "personalization_cost", "product_cost", "markup")
    return lines.withColumn("band", volume_band(amount, bands)).join(table, ["product_id", "band"], "left")


def customization_prices(prices: DataFrame, types: DataFrame, bridge: DataFrame) -> DataFrame:
    """Customisation price rows per product, through the type bridge."""
    t = types.select(F.col("id").alias("product_customization_type_id"))
    return (
        prices.join(t, "product_customization_type_id")
        .join(bridge, "product_customization_type_id")
        .select("product_id", F.col("quantity").alias("units"), "price", F.col("markup").alias("price_markup"))
    )


def price_grid(
    products: DataFrame,
    ranges: DataFrame,
    custom: DataFrame,
    carry: Sequence[str],
    bands: Sequence[int] = GRID_BANDS,
) -> DataFrame:
    """Lowest cost-plus-customisation price of each band, one column per band.

    The cheapest customisation of a product and band decides, so the many
    customisation rows are reduced before they meet the products.
    """
    cheapest = (
        custom.where(F.col("units").isin(*bands))
        .groupBy("product_id", "units")
        .agg(F.min(F.col("price") * F.col("price_markup")).alias("extra"))
    )
    own = ranges.where(F.col("units").isin(*bands)).select(
        "product_id", "units", (F.col("product_cost") * F.col("markup")).alias("own")
    )
    priced = own.join(cheapest, ["product_id", "units"]).withColumn("total", F.col("own") + F.col("extra"))
    goods = products.select(F.col("id").alias("product_id"), *carry)
    return (
        priced.join(goods, "product_id")
        .groupBy(*carry)
        .pivot("units", list(bands))
        .agg(F.min("total"))
        .withColumnsRenamed({str(b): f"price_{b}" for b in bands})
    )
