"""Order-level measures: shares, revenue, dates and lateness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlake.functions.time import day


def share_of_total(
    df: DataFrame, keys: Sequence[str], part: str, whole: str, out: str = "share", digits: int = 0, few_rows: bool = False
) -> DataFrame:
    """``whole`` split over the rows of a key in proportion to ``part``; NULL when the total is 0.

    The total comes from an aggregation joined back, not from a window, so a key with
    very many rows is never sorted in one task. Rows that are grouped already, a few for
    each key (``few_rows``), take a window instead, so that ``df`` is computed once.
    """
    share = F.round(
        F.col(whole) * F.col(part) / F.nullif(F.col("_total").cast("double"), F.lit(0.0)), digits
    )
    if few_rows:
        return df.withColumn("_total", F.sum(part).over(Window.partitionBy(*keys))).withColumn(out, share).drop("_total")
    totals = df.groupBy(*keys).agg(F.sum(part).alias("_total"))
    return df.join(totals, list(keys)).withColumn(out, share).drop("_total")


def customer_revenue(sales: DataFrame, years: Sequence[int], date_col: str = "order_date") -> DataFrame:
    """Per company: revenue of each year, in total, number of orders, mean order value; one pass."""
    price = F.col("total_price")
    per_year = [
        F.sum(F.when(F.year(day(date_col)) == y, price)).alias(f"revenue_{y}") for y in years
    ]
    return (
        sales.groupBy("company_id")
        .agg(*per_year, F.sum(price).alias("revenue_total"), F.count("id").alias("orders"), F.count(price).alias("_priced"))
        .withColumn("mean_ticket", F.col("revenue_total").cast("double") / F.nullif(F.col("_priced"), F.lit(0)))
        .drop("_priced")
    )


def status_date(edits: DataFrame, status: str = "TO_PRODUCE") -> DataFrame:
    """Latest time each order entered a status."""
    return (
        edits.where(F.col("new_status") == status)
        .groupBy("sale_id")
        .agg(F.max("created_at").alias("entered_at"))
    )


def last_delivery(sales: DataFrame, items: DataFrame, moves: DataFrame, since: str = "2024-01-01") -> DataFrame:
    """Latest arrival over the live items of each live order created since a date."""
    orders = sales.where(
        (F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("status") != "CANCELED")
    ).select(F.col("id").alias("sale_id"), "code")
    lines = items.where(F.col("status") != "CANCELED").select("id", "sale_id")
    lines = lines.join(orders.select("sale_id"), "sale_id", "left_semi")
    # only moves of the kept lines
    own = moves.select(F.col("sale_item_id").alias("id"), "arrived_at").join(lines.select("id"), "id", "left_semi")
    arrivals = own.groupBy("id").agg(F.max("arrived_at").alias("arrived_at"))
    per_sale = (
        lines.join(arrivals, "id", "left").groupBy("sale_id").agg(F.max("arrived_at").alias("last_delivery_at"))
    )
    return orders.join(per_sale, "sale_id")


def late_for_client(shipped: Column, promised: Column) -> Column:
    return F.coalesce(shipped > promised, F.lit(False))


def late_for_operation(shipped: Column, promised: Column, due: Column) -> Column:
    return F.coalesce((shipped > due) & (shipped > promised), F.lit(False))
