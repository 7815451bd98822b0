"""Product, price and supplier reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.functions.text import concat_skip_null, decimal_comma, first_part, string_agg_distinct
from bizlake.functions.time import as_of_ts, day, local_ts, week_label, week_start
from bizlake.operators.changelog import first_seen
from bizlake.operators.keys import first_per_key
from bizlake.operators.pricing import GRID_BANDS, customization_prices, price_grid
from bizlake.plans.common import IMAGE_URL, pick, suppliers_as, up
from bizlake.sources.tables import Tables

# Suppliers whose prices are kept elsewhere.
EXCLUDED_SUPPLIERS = ("spot", "asia", "xbz")


def product_catalog(t: Tables, as_of=None, months: int = 6) -> DataFrame:
    """Product: groups, price row at 50 units (else the lowest band), first image, recent sales and quotes."""
    since = as_of_ts(as_of) - F.expr(f"INTERVAL '{months}' MONTH")
    recent_sales = t.sales.where(F.col("created_at") >= since).select(F.col("id").alias("sale_id"))
    bought = pick(t.sale_item_production_infos, sale_item_id="id", purchased_quantity="pieces")
    sold = (
        t.sale_items.select("id", "sale_id", "product_id", "final_price")
        .join(recent_sales, "sale_id", "left_semi")
        .join(bought, "id", "left")
        .groupBy("product_id")
        .agg(
            F.sum("pieces").alias("total_quantity_sold"),
            F.sum(F.col("final_price") * F.col("pieces")).alias("total_value_sold"),
        )
    )
    recent_quotes = t.quotes.where(F.col("created_at") >= since).select(F.col("id").alias("quote_id"))
    quoted = (
        t.quote_items.select("quote_id", "product_id", "amount", "final_price")
        .join(recent_quotes, "quote_id", "left_semi")
        .groupBy("product_id")
        .agg(
            F.sum("amount").alias("total_quantity_quoted"),
            F.sum(F.col("amount") * F.col("final_price")).alias("total_quotes"),
        )
    )
    ranges = t.pricing_ranges.select(
        "product_id", "units", decimal_comma("markup").alias("markup"),
        decimal_comma("personalization_cost").alias("personalization_cost"),
        decimal_comma("product_cost").alias("product_cost"),
    )
    price = first_per_key(ranges, ["product_id"], [F.col("units") != 50, "units"])
    image = first_per_key(t.product_images.select("product_id", "image_data", "created_at"), ["product_id"], ["created_at", "image_data"])
    member = t.products_groups.join(pick(t.groups, id="group_id", name="group_name", active="active"), "group_id", "left")
    state = concat_skip_null(
        F.col("group_name"), " (", F.when(F.col("active"), "Ativo").otherwise("Inativo"), ")"
    )
    groups = member.groupBy("product_id").agg(
        string_agg_distinct("group_name").alias("group_names"), string_agg_distinct(state).alias("group_status")
    )
    # A product without groups still shows the text its empty group gives.
    no_group = F.lit(" (Inativo)")
    goods = t.products.withColumnsRenamed(
        {"id": "product_id", "default_supplier_id": "supplier_id", "default_customizer_id": "customizer_id", "tags": "tag"}
    ).drop("image_data", "credit_tax", "substitution_tax")
    rows = (
        goods.join(pick(t.product_categories, id="category_id", name="category_name"), "category_id", "left")
        .join(suppliers_as(t, "supplier"), "supplier_id", "left")
        .join(suppliers_as(t, "customizer"), "customizer_id", "left")
        .join(groups, "product_id", "left")
        .join(price, "product_id", "left")
        .join(image.drop("created_at"), "product_id", "left")
        .join(sold, "product_id", "left")
        .join(quoted, "product_id", "left")
    )
    zero = F.lit(0)
    return rows.select(
        "name", "image_data", "created_at", "updated_at", "category_name", "sku", "description", "short_description",
        "mockup_link", "template_link", "internal_note", "tag", "status", "ncm", "sizes_grid_id", "brand_id",
        "handling_range_size_id",
        F.col("supplier_name").alias("default_supplier_name"),
        F.col("customizer_name").alias("default_customizer_name"),
        "product_id",
        "group_names",
        F.coalesce("group_status", no_group).alias("group_status"),
        "units", "markup", "personalization_cost", "product_cost",
        F.coalesce("total_quantity_sold", zero).alias("total_quantity_sold"),
        F.coalesce("total_value_sold", zero).alias("total_value_sold"),
        F.coalesce("total_quantity_quoted", zero).alias("total_quantity_quoted"),
        F.coalesce("total_quotes", zero).alias("total_quotes"),
        "production_time", "turbo_production_time",
    ).orderBy(*up("sku", "product_id"))


def product_first_seen(t: Tables) -> DataFrame:
    """SKU: local day of its earliest log row as product, image or price."""
    def of(df: DataFrame, product: str) -> DataFrame:
        return df.select(F.col("id").cast("string").alias("item_id"), F.col(product).alias("product_id"))

    resolvers = {
        "Product": of(t.products, "id"),
        "ProductImage": of(t.product_images, "product_id"),
        "PricingRange": of(t.pricing_ranges, "product_id"),
    }
    seen = first_seen(t.versions, resolvers, t.products)
    return seen.select("sku", F.col("first_seen_on").alias("real_create_date")).orderBy(*up("sku"))


def cost_adjustments(t: Tables, excluded: Sequence[str] = EXCLUDED_SUPPLIERS) -> DataFrame:
    """Product x price band, without some suppliers; a product with no supplier name drops too."""
    names = suppliers_as(t, "supplier").where(~F.lower("supplier_name").isin(*excluded))
    goods = t.products.select(
        F.col("id").alias("product_id"), "sku", F.col("name").alias("product_name"), "credit_tax", "substitution_tax",
        F.col("default_supplier_id").alias("supplier_id"),
    )
    ranges = t.pricing_ranges.select("product_id", "units", "product_cost", "markup")
    return ranges.join(goods.join(names, "supplier_id"), "product_id").select(
        "sku", "product_name", "supplier_name", "units", "product_cost", "markup", "credit_tax", "substitution_tax"
    )


def weekly_costs(t: Tables, status: str = "ACTIVE") -> DataFrame:
    """Active product x price band with the prefix of the supplier's article code."""
    codes = t.supplier_products.groupBy("product_id").agg(F.min(first_part("sku")).alias("supplier_sku"))
    goods = t.products.where(F.col("status") == status).select(
        F.col("id").alias("product_id"), "sku", "internal_note", F.col("default_supplier_id").alias("supplier_id")
    )
    goods = goods.join(suppliers_as(t, "supplier"), "supplier_id", "left").join(codes, "product_id", "left")
    rows = t.pricing_ranges.select("product_id", "units", "product_cost", "markup").join(goods, "product_id")
    return (
        rows.groupBy("sku", "internal_note", "units", "product_cost", "markup", "supplier_name")
        .agg(F.min("supplier_sku").alias("supplier_sku"))
        .select(
            "sku", "internal_note", F.col("units").alias("pricing_units"), "product_cost", "markup",
            F.col("supplier_name").alias("default_supplier_name"), "supplier_sku",
        )
    )


def sku_price_grid(t: Tables, image_url: str = IMAGE_URL) -> DataFrame:
    """Active SKU: lowest total price at 50, 100 and 1000 units, with its image link."""
    goods = t.products.where(F.col("status") == "ACTIVE").withColumn(
        "image_id", F.from_json("image_data", "struct<id:string>")["id"]
    )
    custom = customization_prices(
        t.product_customization_prices, t.product_customization_types, t.product_customization_types_products
    )
    grid = price_grid(goods, t.pricing_ranges, custom, ["sku", "name", "short_description", "image_id"], GRID_BANDS)
    return grid.select(
        F.col("sku").alias("SKU"),
        F.col("name").alias("Nome"),
        F.col("short_description").alias("Descrição Curta"),
        *[F.col(f"price_{b}").alias(f"Preço {b} unid.") for b in GRID_BANDS],
        F.concat(F.lit(image_url), F.col("image_id")).alias("Imagem"),
    ).orderBy(*up("SKU", "Nome"))


def supplier_base(t: Tables) -> DataFrame:
    """Supplier with local dates, the Monday of its creation week, and the week label."""
    created = local_ts("created_at")
    return t.suppliers.select(
        "id", "trading_name", created.alias("created_at"), local_ts("updated_at").alias("updated_at"),
        "storage_supplier", "company_name", "document_number", "payment_period_in_days",
        week_start(day(created)).alias("semana_data"),
        week_label(day(created)).alias("semana_formatada"),
    )
