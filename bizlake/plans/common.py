"""Small helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.functions.labels import NO_PLAN
from bizlake.functions.time import fmt, local_ts
from bizlake.operators.sieve import sieve

# Date patterns of the report columns.
DMY_SLASH = "dd/MM/yyyy"
DMY_DASH = "dd-MM-yyyy"
YMD = "yyyy-MM-dd"

# Text that names the house running the reports; callers pass their own.
HOUSE = "Casa"
ADMIN_URL = "https://admin.example.org/vendas/"
IMAGE_URL = "https://images.example.org/store/"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Chosen columns under new names: ``pick(companies, id="company_id")``."""
    return df.select(*[F.col(c).alias(new) for c, new in names.items()])


def up(*columns: str | Column) -> list[Column]:
    """Ascending, NULLs last."""
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in columns]


def down(column: str | Column) -> Column:
    """Descending, NULLs first."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


def local_text(c: str | Column, pattern: str, mode: str = "utc_to_local") -> Column:
    return fmt(local_ts(c, mode=mode), pattern)


def plan_rows(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per subscription: company and plan name (no-plan label when the plan is unknown)."""
    named = pick(plans, id="plan_id", name="plan_name")
    return subscriptions.join(named, "plan_id", "left").select(
        "company_id", F.coalesce("plan_name", F.lit(NO_PLAN)).alias("plan_name")
    )


def suppliers_as(t, role: str) -> DataFrame:
    """The supplier dimension under a role: key ``<role>_id``, name ``<role>_name``."""
    return pick(t.suppliers, id=f"{role}_id", trading_name=f"{role}_name")


def admins_as(t, role: str) -> DataFrame:
    return pick(t.admin_users, id=f"{role}_id", first_name=f"{role}_name")


def articles(t) -> DataFrame:
    """Customer articles with the catalogue product and category behind them."""
    own = pick(
        t.customer_products, id="customer_product_id", company_id="owner_id", product_id="product_id", sku="cp_sku",
        name="cp_name", ncm="cp_ncm", internal_note="cp_note", unit_price="unit_price",
        unique_inventory_amount="unique_inventory_amount",
    )
    catalogue = pick(t.products, id="product_id", sku="p_sku", name="p_name", ncm="p_ncm", category_id="category_id")
    categories = pick(t.product_categories, id="category_id", name="category_name")
    return own.join(catalogue, "product_id", "left").join(categories, "category_id", "left")


def with_suppliers(rows: DataFrame, t) -> DataFrame:
    """Rows with both supplier names."""
    return rows.join(suppliers_as(t, "supplier"), "supplier_id", "left").join(
        suppliers_as(t, "customizer"), "customizer_id", "left"
    )


def item_costs(t, ids: DataFrame | None = None) -> DataFrame:
    """Production information of each sale item (of ``ids``, if given) with both supplier names."""
    infos = t.sale_item_production_infos.withColumnsRenamed(
        {"product_supplier_id": "supplier_id", "product_customizer_id": "customizer_id"}
    )
    if ids is not None:
        infos = sieve(infos, ids, "sale_item_id").join(ids, "sale_item_id", "left_semi")
    return with_suppliers(infos, t)


def products_of(t) -> DataFrame:
    """Catalogue products with their category."""
    goods = pick(t.products, id="product_id", sku="sku", name="product_name", category_id="category_id", created_at="product_created_at")
    return goods.join(pick(t.product_categories, id="category_id", name="category_name"), "category_id", "left")
