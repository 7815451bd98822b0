"""Customer cohorts by the quarter of the first order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bizlake.functions.labels import NO_PLAN, employee_band
from bizlake.functions.time import as_of_ts, quarter_index, quarter_label

# Order states that count as a purchase, and those that count as kept.
ACTIVE_STATUSES = ("TO_PRODUCE", "PRODUCING", "WAITING_PAYMENT", "AVAILABLE_IN_INVENTORY")
KEPT_STATUSES = ("AVAILABLE_IN_INVENTORY", "DELIVERED")
QUARTERS = 12
CELL = ["cohort_idx", "plan_name", "employee_range"]


def company_plans(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Distinct plan names per company; a company may have several."""
    named = plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name"))
    return subscriptions.join(named, "plan_id", "left").select("company_id", "plan_name").distinct()


def with_plan(df: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Add the plan name(s) of ``company_id``; companies with none get the no-plan label."""
    joined = df.join(company_plans(subscriptions, plans), "company_id", "left")
    return joined.withColumn("plan_name", F.coalesce("plan_name", F.lit(NO_PLAN)))


def purchases(sales: DataFrame, statuses: Sequence[str] = ACTIVE_STATUSES) -> DataFrame:
    return sales.where(F.col("status").isin(*statuses))


def cohort_first(
    sales: DataFrame, companies: DataFrame, subscriptions: DataFrame, plans: DataFrame
) -> DataFrame:
    """First order of each company and plan, with its quarter and head-count band.

    Sales are reduced to one row per company before any join.
    """
    first = purchases(sales).groupBy("company_id").agg(F.min("created_at").alias("first_order_at"))
    firms = companies.select(
        F.col("id").alias("company_id"),
        F.col("name").alias("company_name"),
        employee_band("employees_quantity").alias("employee_range"),
    )
    return with_plan(first.join(firms, "company_id"), subscriptions, plans).withColumn(
        "cohort_idx", quarter_index("first_order_at")
    )


def delivered_quarters(deliveries: DataFrame, sales: DataFrame, items: DataFrame, sale_key: str) -> DataFrame:
    """Distinct (company, quarter) with a delivered sale item.

    ``sale_key`` 'snapshot' takes the sale named in the log row (the item only has to
    exist), 'item' the sale of the item.
    """
    logged = deliveries.select(
        "sale_item_id", F.col("sale_id").alias("logged_sale"), quarter_index("created_at").alias("quarter_idx")
    ).distinct()
    known = items.select(F.col("id").alias("sale_item_id"), "sale_id")
    rows = logged.join(known, "sale_item_id")
    buyers = sales.select(F.col("id").alias("sale_id"), "company_id")
    if sale_key == "snapshot":
        kind = sales.schema["id"].dataType
        rows = rows.select(F.col("logged_sale").cast(kind).alias("sale_id"), "quarter_idx").distinct()
    elif sale_key != "item":
        raise ValueError(f"unknown sale_key {sale_key!r}")
    return rows.select("sale_id", "quarter_idx").distinct().join(buyers, "sale_id").select("company_id", "quarter_idx").distinct()


def _offset() -> Column:
    return F.col("quarter_idx") - F.col("cohort_idx") + 1


def _in_cells(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts per (company, quarter) placed in the cohort cell of their relative quarter."""
    placed = facts.join(members, "company_id").withColumn("relative_quarter", _offset())
    return placed.where(F.col("relative_quarter").between(1, QUARTERS))


def _grid(members: DataFrame) -> DataFrame:
    """One row per cohort cell and relative quarter, with the cohort's size."""
    size = members.groupBy(*CELL).agg(F.count_distinct("company_id").alias("companies_in_quarter"))
    return size.withColumn("relative_quarter", F.explode(F.sequence(F.lit(1), F.lit(QUARTERS))))


def _closed(as_of) -> Column:
    """The cell's calendar quarter lies before the current one."""
    return F.col("cohort_idx") + F.col("relative_quarter") - 1 < quarter_index(as_of_ts(as_of))


def _running(c: str) -> Column:
    # At most QUARTERS rows per partition.
    return F.sum(c).over(W.partitionBy(*CELL).orderBy("relative_quarter"))


def _percent(part: Column | str, whole: Column | str) -> Column:
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return F.round(F.lit(100).cast("decimal(3,0)") * p.cast("decimal(24,2)") / F.nullif(w.cast("decimal(24,2)"), F.lit(0).cast("decimal(24,2)")), 2)


def cohort_matrix(members: DataFrame, sales: DataFrame, delivered: DataFrame, as_of=None) -> DataFrame:
    """Cohort x relative quarter with distinct revenue, orders, retention, running sums and shares.

    Revenue adds each distinct order price of a cell once. Sales and deliveries are
    aggregated separately, so they never multiply each other.
    """
    members = members.select("company_id", *CELL)
    per_company = (
        purchases(sales)
        .select("company_id", quarter_index("created_at").alias("quarter_idx"), "total_price", "status")
        .groupBy("company_id", "quarter_idx", "total_price")
        .agg(F.count("*").alias("orders"), F.bool_or(F.col("status").isin(*KEPT_STATUSES)).alias("kept"))
    )
    cells = [*CELL, "relative_quarter"]
    placed = _in_cells(members, per_company)
    # Companies and prices of a cell are each made distinct by a plain grouping, so no row is copied for another distinct count.
    by_company = placed.groupBy(*cells, "company_id").agg(F.sum("orders").alias("orders"), F.bool_or("kept").alias("kept"))
    counts = by_company.groupBy(*cells).agg(
        F.sum("orders").alias("orders_in_quarter"), F.count("*").alias("active_companies_in_quarter"), F.count_if("kept").alias("retencao_venda")
    )
    prices = placed.select(*cells, "total_price").distinct().groupBy(*cells).agg(F.sum("total_price").alias("revenue_in_quarter"))
    bought = counts.join(prices, cells)
    shipped = _in_cells(members, delivered).groupBy(*cells).agg(
        F.count_distinct("company_id").alias("retencao_envio")
    )
    measures = ["revenue_in_quarter", "orders_in_quarter", "active_companies_in_quarter", "retencao_venda", "retencao_envio"]
    grid = _grid(members).join(bought, cells, "left").join(shipped, cells, "left")
    grid = grid.fillna(0, subset=measures).where(_closed(as_of))
    first_quarter = F.max(F.when(F.col("relative_quarter") == 1, F.col("revenue_in_quarter"))).over(W.partitionBy(*CELL))
    return grid.withColumns(
        {
            "cumulative_orders": _running("orders_in_quarter"),
            "cumulative_revenue": _running("revenue_in_quarter"),
            "retencao_envio_percentual": _percent("retencao_envio", "companies_in_quarter"),
            "retencao_venda_percentual": _percent("retencao_venda", "companies_in_quarter"),
            "percentual_receita_vs_q1": _percent("revenue_in_quarter", first_quarter),
            "cohort": quarter_label("cohort_idx"),
            "real_quarter": quarter_label(F.col("cohort_idx") + F.col("relative_quarter") - 1),
        }
    )


def cohort_retention(members: DataFrame, sales: DataFrame, delivered: DataFrame, as_of=None) -> DataFrame:
    """The same grid with plain revenue sums; only cohorts that earned in their first quarter."""
    members = members.select("company_id", *CELL)
    per_company = (
        purchases(sales)
        .groupBy("company_id", quarter_index("created_at").alias("quarter_idx"))
        .agg(F.count("*").alias("orders"), F.sum("total_price").alias("total_price"))
    )
    cells = [*CELL, "relative_quarter"]
    bought = (
        _in_cells(members, per_company)
        .groupBy(*cells)
        .agg(
            F.count_distinct("company_id").alias("active_companies_in_quarter"),
            F.sum("orders").alias("orders_in_quarter"),
            F.sum("total_price").alias("revenue_in_quarter"),
        )
    )
    shipped = _in_cells(members, delivered).groupBy(*cells).agg(
        F.count_distinct("company_id").alias("retencao_envio")
    )
    grid = _grid(members).join(bought, cells, "left").join(shipped, cells, "left")
    grid = grid.fillna(0, subset=["active_companies_in_quarter", "orders_in_quarter", "revenue_in_quarter", "retencao_envio"])
    base = W.partitionBy(*CELL)
    return (
        grid.withColumns(
            {
                "revenue_q1": F.max(F.when(F.col("relative_quarter") == 1, F.col("revenue_in_quarter"))).over(base),
                "cumulative_orders": _running("orders_in_quarter"),
                "cumulative_revenue": _running("revenue_in_quarter"),
                "retencao_venda": F.col("active_companies_in_quarter"),
                "base_companies_in_q1": F.col("companies_in_quarter"),
                "cohort": quarter_label("cohort_idx"),
            }
        )
        .where(F.col("revenue_q1") > 0)
        .where(_closed(as_of))
    )
