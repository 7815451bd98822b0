"""Cohort reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.functions.time import quarter_index, quarter_label
from bizlake.operators.changelog import deliveries
from bizlake.operators.cohort import cohort_first, cohort_matrix, cohort_retention, delivered_quarters, purchases
from bizlake.plans.common import up
from bizlake.sources.tables import Tables


def _members(t: Tables) -> DataFrame:
    return cohort_first(t.sales, t.companies, t.subscriptions, t.plans)


def cohort_customers(t: Tables) -> DataFrame:
    """One row per purchase of a company and plan: cohort quarter and real quarter."""
    members = _members(t).select(
        "company_id", "company_name", "plan_name", "employee_range", quarter_label("cohort_idx").alias("cohort")
    )
    bought = purchases(t.sales).select("company_id", quarter_label(quarter_index("created_at")).alias("real_quarter"))
    return bought.join(members, "company_id").select(
        "company_name", "plan_name", "employee_range", "cohort", "real_quarter"
    ).orderBy(*up("cohort", "real_quarter", "company_name"))


def cohort(t: Tables, as_of=None) -> DataFrame:
    """Cohort x relative quarter: revenue of distinct prices, orders, retention, running sums, shares."""
    delivered = delivered_quarters(deliveries(t.versions), t.sales, t.sale_items, "snapshot")
    grid = cohort_matrix(_members(t), t.sales, delivered, as_of)
    return grid.orderBy(*up("cohort_idx", "plan_name", "employee_range", "relative_quarter")).select(
        "cohort", "relative_quarter", "plan_name", "employee_range", "companies_in_quarter",
        "active_companies_in_quarter", "orders_in_quarter", "revenue_in_quarter", "cumulative_orders",
        "cumulative_revenue", "retencao_envio", "retencao_venda", "retencao_envio_percentual",
        "retencao_venda_percentual", "percentual_receita_vs_q1", "real_quarter",
    )


def cohort_retention_report(t: Tables, as_of=None) -> DataFrame:
    """Cohort x relative quarter with plain revenue sums and the first-quarter base."""
    delivered = delivered_quarters(deliveries(t.versions), t.sales, t.sale_items, "item")
    grid = cohort_retention(_members(t), t.sales, delivered, as_of)
    return grid.orderBy(*up("cohort_idx", "plan_name", "employee_range", "relative_quarter")).select(
        "cohort", "relative_quarter", "plan_name", "employee_range", "companies_in_quarter",
        "active_companies_in_quarter", "orders_in_quarter", "revenue_in_quarter", "cumulative_orders",
        "cumulative_revenue", "retencao_envio", "retencao_venda", "revenue_q1", "base_companies_in_q1",
    )
