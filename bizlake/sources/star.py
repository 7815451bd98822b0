"""The role tables derived from the star-schema test tables.

Each role is one SELECT over the star tables, in SQL that Spark and DuckDB both run,
so a report can be checked on the same derived input in both. Dates move 24 years
ahead; the role tables keep every source row (aggregated where the role needs a
unique key, because order and line number together are not unique).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from bizlake.sources.tables import Tables

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

LATER = "INTERVAL '24' YEAR"
SECOND = "INTERVAL '1' SECOND"
HOUR = "INTERVAL '1' HOUR"
DAY = "INTERVAL '1' DAY"
LINE = "l_orderkey * 8 + l_linenumber"
# One row per order and line number. Flags are compared as numbers, so that the
# aggregation keeps fixed-width buffers, and turned back into letters outside.
_FLAG = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
_STATE = "CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END"
BY_LINE = f"""FROM (
        SELECT l_orderkey, l_linenumber, part, own_part, supp_lo, supp_hi, qty, qty_lo, qty_hi, price_lo, price_hi, disc_hi, tax_hi, ship,
            CASE f1 WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS flag_lo, CASE f2 WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS flag_hi,
            CASE s1 WHEN 1 THEN 'F' ELSE 'O' END AS line_lo, CASE s2 WHEN 1 THEN 'F' ELSE 'O' END AS line_hi
        FROM (
            SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS own_part,
                min(l_suppkey) AS supp_lo, max(l_suppkey) AS supp_hi, cast(sum(l_quantity) AS int) AS qty, cast(min(l_quantity) AS int) AS qty_lo,
                cast(max(l_quantity) AS int) AS qty_hi, min(l_extendedprice) AS price_lo, max(l_extendedprice) AS price_hi, max(l_discount) AS disc_hi,
                max(l_tax) AS tax_hi, min(l_shipdate) AS ship, min({_FLAG}) AS f1, max({_FLAG}) AS f2, min({_STATE}) AS s1, max({_STATE}) AS s2
            FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) a) b"""
ORDERED = f"o_orderdate + {LATER} + (o_custkey * 7919 % 86400) * {SECOND}"
SHIPPED = f"ship + {LATER} + (part * 37 % 86400) * {SECOND}"
LINE_AT = f"l_shipdate + {LATER} + (l_partkey * 37 % 86400) * {SECOND}"
PLAN_ID = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END"
MONEY = "decimal(18,2)"
RATE = "decimal(18,4)"


def _pick(subject: str, *pairs: tuple[str, str], other: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs)
    return f"CASE {subject} {arms} ELSE {other} END"


def _price_band(k: int, units: int) -> str:
    keep = " WHERE p_type <> 'LARGE'" if units == 50 else ""
    return (
        f"SELECT p_partkey * 8 + {k} AS id, p_partkey AS product_id, {units} AS units, "
        f"cast(1 + cast(p_size AS decimal(10,2)) / 100 + {k} AS {RATE}) AS markup, "
        f"cast(p_retailprice AS {MONEY}) - {k} AS product_cost, "
        f"cast(p_size AS {MONEY}) + {k} AS personalization_cost FROM {{part}}{keep}"
    )


def _custom_price(units: int) -> str:
    return (
        f"SELECT p_type AS product_customization_type_id, {units} AS quantity, "
        f"cast(min(p_size) + {units} AS {MONEY}) AS price, cast(1.5 AS {RATE}) AS markup FROM {{part}} GROUP BY p_type"
    )


def _item_event(at: str, new: str, changes: str) -> str:
    return (
        f"SELECT 'SaleItem' AS item_type, cast({LINE} AS string) AS item_id, 'update' AS event, "
        f"'{{{{\"status\":\"' || {new} || '\",\"sale_id\":' || cast(l_orderkey AS string) || '}}}}' AS object, "
        f"{changes} AS object_changes, {at} AS created_at FROM {{lineitem}}"
    )


def _change(field: str, old: str, new: str) -> str:
    """JSON text ``{"field":[old,new]}``; ``old`` and ``new`` are SQL giving JSON text."""
    return f"'{{{{\"{field}\":[' || {old} || ',' || {new} || ']}}}}'"


def _quoted(sql: str) -> str:
    return f"('\"' || {sql} || '\"')"


_STAGE2 = "CASE l_returnflag WHEN 'A' THEN 'TO_PRODUCE' WHEN 'N' THEN 'IN_PRODUCTION' ELSE 'IN_QUOTATION' END"
_STAGE3 = "CASE l_returnflag WHEN 'A' THEN 'QUALITY' ELSE 'IN_CUSTOMIZATION' END"
_STAGE4 = "CASE l_linestatus WHEN 'F' THEN 'DELIVERED' ELSE 'CANCELED' END"
_OLD_EVENT = "CASE WHEN value < 20 THEN 'error' WHEN value < 60 THEN 'waiting_picking' ELSE 'mounting' END"
_NEW_EVENT = _pick(
    "event_type", ("click", "'waiting_picking'"), ("error", "'error'"), ("purchase", "'shipped'"),
    ("signup", "'draft'"), other="'waiting_mounting'",
)

_SALE_STATUS = "CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH' THEN 'CANCELED' ELSE " + _pick(
    "o_orderpriority", ("1-URGENT", "'TO_PRODUCE'"), ("2-HIGH", "'PRODUCING'"),
    ("3-MEDIUM", "'WAITING_PAYMENT'"), ("4-NOT SPECIFIED", "'AVAILABLE_IN_INVENTORY'"), other="'TO_BILL'",
) + " END"
_SHIPPING_STATUS = "CASE o_orderstatus WHEN 'P' THEN " + _pick(
    "o_orderpriority", ("1-URGENT", "'canceled'"), ("2-HIGH", "'draft'"), ("3-MEDIUM", "'error'"),
    ("4-NOT SPECIFIED", "'waiting_picking'"), other="'ready_to_ship'",
) + " WHEN 'F' THEN " + _pick(
    "o_orderpriority", ("1-URGENT", "'shipped'"), ("2-HIGH", "'finished'"), ("3-MEDIUM", "'mounting'"),
    ("4-NOT SPECIFIED", "'waiting_labels'"), other="'waiting_items_arrival'",
) + " ELSE " + _pick(
    "o_orderpriority", ("1-URGENT", "'waiting_addresses'"), ("2-HIGH", "'waiting_logistics'"),
    ("3-MEDIUM", "'waiting_mounting'"), ("4-NOT SPECIFIED", "'ready_for_pickup'"), other="'waiting_for_printing'",
) + " END"

ROLE_SQL: dict[str, str] = {
    "sales": f"""SELECT o_orderkey AS id, o_orderkey AS code, o_custkey AS company_id,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS quote_id, {_SALE_STATUS} AS status,
        cast(o_totalprice AS {MONEY}) AS total_price, cast(o_custkey % 90 AS {MONEY}) AS shipment_price,
        cast(o_custkey % 70 AS {MONEY}) AS storage_price, cast(o_custkey % 50 AS {MONEY}) AS additional_value,
        o_orderpriority AS additional_value_description, cast(o_custkey % 30 AS {MONEY}) AS discount_value,
        o_orderstatus AS discount_description, o_orderdate + {LATER} AS order_date, {ORDERED} AS created_at,
        o_orderdate + {LATER} + 25 * {DAY} AS expected_delivery, o_orderdate + {LATER} + 30 * {DAY} AS event_date,
        CASE WHEN o_totalprice < 5000 THEN o_orderdate + {LATER} END AS deleted_at,
        o_orderpriority = '1-URGENT' AS is_event, o_orderstatus = 'F' AS turbo,
        cast(o_custkey AS string) AS seller_id, cast(o_orderkey AS string) AS designer_id,
        o_custkey AS production_assignee_id, o_orderpriority AS payment_method,
        length(o_orderpriority) AS number_of_installments, o_orderpriority AS storage,
        o_orderstatus = 'O' AS redeem_page, o_orderstatus = 'P' AS sample,
        cast(floor(o_totalprice / 10000) AS int) AS sold_kits_amount,
        cast(o_orderkey AS string) AS omie_order_number FROM {{orders}}""",
    "sale_items": f"""SELECT {LINE} AS id, l_orderkey AS sale_id, part AS product_id,
        own_part AS customer_product_id,
        qty AS amount, cast(price_hi AS {MONEY}) AS product_price,
        cast(price_lo AS {MONEY}) AS base_price, cast(price_lo AS {MONEY}) AS final_price,
        CASE flag_lo WHEN 'A' THEN 'PERCENTAGE' WHEN 'N' THEN 'VALUE' ELSE 'NONE' END AS price_modifier_type,
        cast(disc_hi AS {MONEY}) * 100 AS price_modifier_value,
        'https://example.org/' || cast(supp_lo AS string) AS product_supplier_link,
        l_linenumber AS personalization_areas_amount, l_linenumber + 1 AS personalization_colors_amount,
        {_pick("flag_lo || line_lo", ("AF", "'DELIVERED'"), ("AO", "'TO_PRODUCE'"),
               ("NF", "'IN_PRODUCTION'"), ("NO", "'QUALITY'"), ("RF", "'WAITING'"), other="'CANCELED'")} AS status,
        {SHIPPED} AS created_at {BY_LINE}""",
    "sale_item_production_infos": f"""SELECT {LINE} AS sale_item_id, qty AS purchased_quantity,
        CASE WHEN flag_lo <> 'R' THEN qty_lo END AS exceeding_quantity,
        cast(qty_lo AS {MONEY}) AS unit_cost, cast(tax_hi AS {MONEY}) AS customize_cost,
        supp_lo AS product_supplier_id,
        CASE WHEN flag_lo <> 'N' THEN supp_hi END AS product_customizer_id,
        ship + {LATER} - 9 * {DAY} AS purchase_date, ship + {LATER} - 5 * {DAY} AS customizer_arrival_date,
        CASE WHEN line_lo = 'F' THEN ship + {LATER} END AS arrival_forecast_date,
        line_lo = 'F' AS filled, supp_lo AS buyer_id,
        cast(supp_lo AS string) AS omie_order_code {BY_LINE}""",
    "sale_item_design_infos": f"""SELECT {LINE} AS sale_item_id, flag_lo = 'A' AS filled,
        CASE flag_lo WHEN 'A' THEN 'laser' ELSE 'silk' END AS customization_type,
        line_lo AS customization_colors, flag_hi AS art_size {BY_LINE}""",
    "sale_item_images": f"SELECT {LINE} AS sale_item_id FROM {{lineitem}}",
    "sale_status_edits": f"""SELECT o_orderkey AS sale_id, 'TO_PRODUCE' AS new_status, {ORDERED} + 2 * {DAY} AS created_at FROM {{orders}}
        UNION ALL SELECT o_orderkey, 'PRODUCING', {ORDERED} + 5 * {DAY} FROM {{orders}}
        UNION ALL SELECT o_orderkey, 'TO_PRODUCE', {ORDERED} + 3 * {DAY} FROM {{orders}} WHERE o_orderstatus = 'F'""",
    "companies": f"""SELECT c_custkey AS id, c_name AS name, 'C' || cast(c_custkey AS string) AS cnpj,
        CASE WHEN c_mktsegment <> 'FURNITURE' THEN cast(floor(c_acctbal / 5) AS int) END AS employees_quantity,
        cast(c_acctbal AS {MONEY}) AS credit_balance, lower(c_name) || '@example.org' AS financial_email FROM {{customer}}""",
    "users": """SELECT c_custkey AS id, c_nationkey AS company_id, c_name AS first_name, c_mktsegment AS last_name,
        'u' || cast(c_custkey AS string) || '@example.org' AS email, cast(c_custkey AS string) AS phone,
        c_mktsegment AS job_position FROM {customer}""",
    "admin_users": """SELECT s_suppkey AS id, s_name AS first_name,
        CASE WHEN s_nationkey > 2 THEN 'N' || cast(s_nationkey AS string) END AS last_name FROM {supplier}""",
    "subscriptions": f"""SELECT c_custkey AS company_id, {PLAN_ID} AS plan_id,
        TIMESTAMP '2020-01-01 00:00:00' + c_nationkey * {DAY} AS created_at FROM {{customer}} WHERE c_mktsegment <> 'FURNITURE'
        UNION ALL SELECT c_custkey, 4, TIMESTAMP '2020-01-10 00:00:00' FROM {{customer}} WHERE c_mktsegment = 'AUTOMOBILE'""",
    "plans": f"""SELECT {PLAN_ID} AS id, CASE {PLAN_ID} WHEN 1 THEN 'Enterprise' WHEN 2 THEN 'Plano Pró'
        WHEN 3 THEN 'Essential' ELSE 'Free' END AS name FROM {{customer}} WHERE c_mktsegment <> 'FURNITURE' GROUP BY c_mktsegment""",
    "teams": "SELECT c_custkey AS id, c_nationkey AS company_id, 'Team ' || c_mktsegment AS name FROM {customer}",
    "products": f"""SELECT p_partkey AS id,
        CASE WHEN p_size = 2 THEN '' WHEN p_size > 2 THEN p_brand || '-' || cast(p_size AS string) END AS sku,
        p_name AS name, CASE WHEN p_type = 'PROMO' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, p_type AS category_id,
        'about ' || p_name AS description, p_name AS short_description, 'mock-' || p_brand AS mockup_link,
        'tpl-' || p_brand AS template_link, p_brand AS internal_note, '["' || p_type || '"]' AS tags,
        CASE WHEN p_size = 7 THEN '.' ELSE cast(p_size AS string) END AS ncm, p_size AS sizes_grid_id,
        p_brand AS brand_id, p_size AS handling_range_size_id, p_size AS default_supplier_id,
        p_size + 1 AS default_customizer_id,
        '{{{{"id":"img-' || cast(p_partkey AS string) || '"}}}}' AS image_data, cast(p_size AS {MONEY}) AS credit_tax,
        cast(p_size * 2 AS {MONEY}) AS substitution_tax, p_size AS production_time, p_size + 3 AS turbo_production_time,
        TIMESTAMP '2021-01-01 00:00:00' + p_size * {DAY} AS created_at,
        TIMESTAMP '2021-06-01 00:00:00' + p_size * {DAY} AS updated_at FROM {{part}}""",
    "product_categories": "SELECT DISTINCT p_type AS id, 'Cat ' || p_type AS name FROM {part}",
    "product_images": f"""SELECT p_partkey * 2 AS id, p_partkey AS product_id, 'b' || cast(p_partkey AS string) AS image_data,
        TIMESTAMP '2021-02-20 00:00:00' + p_size * {DAY} AS created_at FROM {{part}}
        UNION ALL SELECT p_partkey * 2 + 1, p_partkey, 'a' || cast(p_partkey AS string),
        TIMESTAMP '2021-03-10 00:00:00' FROM {{part}} WHERE p_type <> 'SMALL'""",
    "pricing_ranges": " UNION ALL ".join(_price_band(k, u) for k, u in enumerate((50, 100, 250, 500, 1000))),
    "groups": "SELECT DISTINCT p_brand AS id, 'Group ' || p_brand AS name, p_brand <> 'Brand#1' AS active FROM {part}",
    "products_groups": """SELECT p_partkey AS product_id, p_brand AS group_id FROM {part}
        UNION ALL SELECT p_partkey, 'Brand#1' FROM {part} WHERE p_size > 10""",
    "product_customization_prices": " UNION ALL ".join(_custom_price(u) for u in (50, 100, 1000)),
    "product_customization_types": "SELECT DISTINCT p_type AS id FROM {part}",
    "product_customization_types_products": """SELECT p_partkey AS product_id, p_type AS product_customization_type_id FROM {part}
        UNION ALL SELECT p_partkey, 'ECONOMY' FROM {part} WHERE p_type <> 'ECONOMY'""",
    "suppliers": f"""SELECT s_suppkey AS id, CASE s_nationkey WHEN 0 THEN 'Spot' WHEN 1 THEN 'ASIA' WHEN 2 THEN 'xbz'
        WHEN 3 THEN NULL ELSE s_name END AS trading_name, s_name AS company_name,
        'D' || cast(s_suppkey AS string) AS document_number, s_nationkey + 5 AS payment_period_in_days,
        s_nationkey > 10 AS storage_supplier,
        TIMESTAMP '2023-12-20 02:00:00' + s_suppkey * {DAY} + (s_suppkey * 7 % 24) * {HOUR} AS created_at,
        TIMESTAMP '2024-06-20 02:00:00' + s_suppkey * {DAY} AS updated_at FROM {{supplier}}""",
    "supplier_products": """SELECT p_partkey AS product_id, ' S' || cast(p_size AS string) || ' - x' AS sku FROM {part}
        UNION ALL SELECT p_partkey, 'A' || cast(p_size AS string) FROM {part} WHERE p_size > 30""",
    "quotes": f"""SELECT o_orderkey AS id, o_orderkey AS code, o_orderpriority AS kit_purpose, o_custkey AS designer_id,
        cast(o_totalprice AS {MONEY}) AS total_price, cast(o_custkey % 90 AS {MONEY}) AS shipment_price,
        cast(o_custkey % 70 AS {MONEY}) AS storage_price, cast(o_custkey % 50 AS {MONEY}) AS additional_value,
        o_orderpriority AS additional_value_description, cast(o_custkey % 30 AS {MONEY}) AS discount_value,
        o_orderstatus AS discount_description, cast(o_custkey % 20 AS {MONEY}) AS budget_per_kit,
        o_orderstatus = 'F' AS turbo, {ORDERED} AS created_at FROM {{orders}}""",
    "quote_items": f"""SELECT {LINE} AS id, l_orderkey AS quote_id, part AS product_id,
        qty AS amount, cast(price_lo AS {MONEY}) AS final_price,
        {SHIPPED} AS created_at {BY_LINE}""",
    "customer_products": f"""SELECT p_partkey AS id, c_custkey AS company_id,
        CASE WHEN p_type <> 'SMALL' THEN p_partkey END AS product_id, p_size AS sizes_grid_id,
        'CP-' || p_brand AS sku, CASE WHEN p_size <> 50 THEN 'own ' || p_name END AS name,
        CASE WHEN p_size = 9 THEN '.' ELSE cast(p_size AS string) END AS ncm, p_brand AS internal_note,
        CASE WHEN p_type <> 'PROMO' THEN cast(p_retailprice AS {MONEY}) END AS unit_price,
        CASE WHEN p_size > 5 THEN p_size END AS unique_inventory_amount
        FROM {{part}} LEFT JOIN {{customer}} ON c_custkey = p_partkey""",
    "customer_product_sizes": """SELECT p_partkey * 2 AS id, p_partkey AS customer_product_id, 'M' AS name,
        p_size - 10 AS inventory_amount FROM {part} WHERE p_type IN ('LARGE', 'ECONOMY')
        UNION ALL SELECT p_partkey * 2 + 1, p_partkey, 'G', p_size FROM {part} WHERE p_type = 'LARGE'""",
    "customer_products_inventory_addresses": "SELECT p_partkey AS customer_product_id FROM {part} WHERE p_size > 25",
    "sizes_grids": "SELECT DISTINCT p_size AS id FROM {part}",
    "inventory_moves": f"""SELECT {LINE} AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 8 + 1 END AS parent_id,
        part AS customer_product_id,
        CASE WHEN flag_lo <> 'N' THEN part * 2 END AS variant_id,
        l_orderkey * 8 + CASE WHEN l_linenumber > 4 THEN l_linenumber - 3 ELSE l_linenumber END AS sale_item_id,
        {_pick("flag_lo || line_hi", ("AF", "'RECEIPT'"), ("AO", "'RECEIPT'"), ("NF", "'customer_input'"),
               ("NO", "'customer_input'"), ("RF", "'picking'"), other="'manual_input'")} AS operation_type,
        CASE WHEN line_lo = 'F' THEN 'COMPLETED' WHEN tax_hi < 0.02 THEN 'TO_CHECK'
             WHEN tax_hi < 0.04 THEN 'TO_PROCESS' WHEN tax_hi < 0.06 THEN 'FAILURE' ELSE 'CANCELED' END AS status,
        'R' || cast(l_orderkey AS string) AS reference_code, flag_lo AS notes,
        CASE WHEN disc_hi < 0.08 THEN qty END AS quantity,
        qty_hi AS expected_quantity, l_linenumber AS scrap_quantity,
        qty_lo AS exceeding_quantity,
        CASE WHEN line_lo = 'F' THEN {SHIPPED} + 2 * {DAY} END AS arrived_at,
        ship + {LATER} + 4 * {DAY} AS estimated_arrival_date,
        date_trunc('year', ship) + {LATER} AS created_at, {SHIPPED} + 3 * {DAY} AS updated_at {BY_LINE}""",
    "loss_reports": f"""SELECT {LINE} AS inventory_move_id,
        CASE l_linenumber WHEN 1 THEN 'kNEADED' WHEN 2 THEN 'RISKS' WHEN 3 THEN 'DEFECTIVE_ART' WHEN 4 THEN 'NO_ART'
             ELSE 'OTHER' END AS reason,
        cast(l_quantity AS int) AS quantity, {LINE_AT} AS created_at FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "shipping_orders": f"""SELECT o_orderkey AS id, o_orderkey AS code, 'Envio ' || o_orderpriority AS title,
        o_custkey AS company_id, o_custkey AS team_id, {_SHIPPING_STATUS} AS status,
        {_pick("o_orderpriority", ("1-URGENT", "'customer_app'"), ("2-HIGH", "'customer_app'"), ("3-MEDIUM", "'redeem'"),
               ("4-NOT SPECIFIED", "'admin_app'"))} AS created_through,
        {_pick("o_orderstatus", ("P", "'loose_items'"), ("F", "'assembled_and_unsealed'"))} AS assembly_type,
        o_orderpriority AS shipping_purpose, cast(floor(o_totalprice / 10000) AS int) AS total_kits_quantity,
        CASE WHEN o_orderpriority <> '5-LOW' OR o_orderstatus <> 'F' THEN o_orderdate + {LATER} + 20 * {DAY} END AS shipment_expected_to,
        {ORDERED} AS created_at, CASE WHEN o_totalprice < 5000 THEN o_orderdate + {LATER} END AS deleted_at FROM {{orders}}""",
    "shipping_order_items": """SELECT l_orderkey AS shipping_order_id, l_partkey AS customer_product_id,
        cast(l_quantity AS int) AS quantity FROM {lineitem}""",
    "shipping_order_sales": """SELECT o_orderkey AS shipping_order_id, o_orderkey AS sale_id FROM {orders}
        UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM {orders} WHERE o_orderstatus = 'F'""",
    "shipping_orders_followers": """SELECT o_orderkey AS shipping_order_id, o_custkey AS follower_id FROM {orders}
        UNION ALL SELECT o_orderkey, cast(floor(o_custkey / 2) AS bigint) FROM {orders} WHERE o_orderstatus <> 'P'""",
    "shipping_orders_customer_kits": """SELECT o_orderkey AS shipping_order_id, length(o_orderpriority) AS customer_kit_id FROM {orders}
        UNION ALL SELECT o_orderkey, 5 FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    "customer_kits": """SELECT DISTINCT length(o_orderpriority) AS id,
        'Kit ' || cast(length(o_orderpriority) AS string) AS name FROM {orders}""",
    "shipments": f"""SELECT {LINE} AS id, l_orderkey AS shipping_order_id, supp_lo AS shipping_service_id,
        {_pick("flag_lo || line_lo", ("AF", "'PACKAGE_RETURNED'"), ("AO", "'DEVIATION'"),
               ("NF", "'DELIVERED'"), other="'SHIPPED'")} AS status,
        {_pick("flag_hi", ("A", "'SHIPPING'"), ("N", "'DEVOLUTION_RESEND'"), other="CASE WHEN l_linenumber > 5 THEN 'WITHDRAWAL' ELSE 'SHIPPING' END")} AS shipment_category,
        'Name ' || cast(supp_lo AS string) AS recipient_name, 'D' || cast(part AS string) AS recipient_document_number,
        'Z' || cast(supp_lo AS string) AS recipient_zipcode, 'Street' AS recipient_street,
        cast(l_linenumber AS string) AS recipient_number, line_hi AS recipient_complement,
        line_lo AS recipient_neighborhood, 'City ' || flag_hi AS recipient_city,
        flag_lo AS recipient_state, 'r' || cast(supp_lo AS string) || '@example.org' AS recipient_email,
        'T' || cast({LINE} AS string) AS tracking_code,
        CASE WHEN l_linenumber > 2 THEN CASE WHEN flag_lo = 'A' THEN 'M' ELSE 'G' END END AS shirt_size,
        CASE WHEN line_lo = 'F' THEN 'B' || cast(l_orderkey AS string) END AS service_bill_id,
        cast(price_hi AS {MONEY}) AS declared_value, cast(qty_hi AS {MONEY}) AS shipment_price,
        cast(qty_lo AS {MONEY}) AS shipment_cost, l_linenumber + 2 AS days_to_deliver,
        CASE WHEN flag_lo = 'A' THEN '[{{{{"description":"OBJETO NÃO ENTREGUE - ' || line_lo || '"}}}},{{{{"description":"postado"}}}},{{{{"description":"Objeto não entregue"}}}},{{{{"description":null}}}}]'
             WHEN flag_lo = 'N' THEN '[]' END AS tracking_events,
        CASE WHEN flag_lo <> 'R' OR line_lo = 'F' THEN {SHIPPED} END AS shipped_at,
        {SHIPPED} + 6 * {HOUR} AS updated_at,
        CASE WHEN tax_hi > 0.075 THEN {SHIPPED} END AS deleted_at {BY_LINE}""",
    "shipment_items": f"""SELECT {LINE} AS shipment_id,
        CASE WHEN l_returnflag <> 'N' OR l_linestatus <> 'O' THEN l_partkey END AS customer_product_id,
        cast(l_quantity AS int) AS quantity FROM {{lineitem}}""",
    "shipping_services": """SELECT s_suppkey AS id, 'Carrier ' || cast(s_nationkey AS string) AS company_name,
        'Service ' || cast(s_suppkey AS string) AS name FROM {supplier}""",
    "versions": " UNION ALL ".join(
        [
            _item_event(LINE_AT, "'WAITING'", _change("status", "'null'", "'\"WAITING\"'")),
            _item_event(f"{LINE_AT} + cast(l_quantity AS int) * {HOUR}", _STAGE2, _change("status", "'\"WAITING\"'", _quoted(_STAGE2))),
            _item_event(f"{LINE_AT} + cast(l_quantity AS int) * 3 * {HOUR}", _STAGE3, _change("status", _quoted(_STAGE2), _quoted(_STAGE3))),
            _item_event(f"{LINE_AT} + cast(l_quantity AS int) * 5 * {HOUR}", _STAGE4, _change("amount", "'1'", "'2'")),
            f"""SELECT 'Shipment', cast({LINE} AS string), 'update', '{{{{}}}}',
                {_change("status", "'\"SHIPPED\"'", "CASE l_linestatus WHEN 'F' THEN '\"DELIVERED\"' ELSE '\"LOST\"' END")},
                {LINE_AT} + cast(l_quantity AS int) * 7 * {HOUR} FROM {{lineitem}}""",
            f"""SELECT 'Shipment', cast({LINE} AS string), 'update', '{{{{}}}}',
                {_change("shipment_expected_to", "'null'", _quoted(f"cast(cast(l_shipdate + {LATER} - l_linenumber * {DAY} AS date) AS string)"))},
                {LINE_AT} - 9 * {DAY} FROM {{lineitem}} WHERE l_returnflag = 'A'""",
            f"""SELECT 'ShippingOrder', cast(user_id AS string), 'update', '{{{{"status":"draft"}}}}',
                {_change("status", _quoted(_OLD_EVENT), _quoted(_NEW_EVENT))}, ts FROM {{events}}""",
            f"""SELECT 'User', cast(user_id AS string), 'update', '{{{{}}}}',
                CASE WHEN event_type IN ('click', 'view') THEN {_change("signin_token", "'\"t\"'", "'null'")}
                     ELSE {_change("signin_token", "'null'", "'\"t\"'")} END, ts + INTERVAL '500' DAY FROM {{events}}""",
            f"""SELECT 'QuoteItemImage', cast({LINE} AS string), CASE WHEN l_returnflag = 'R' THEN 'update' ELSE 'create' END, '{{{{}}}}',
                '{{{{"quote_item_id":[null,"' || cast({LINE} AS string) || '"],"image_data":[null,{{{{"id":"i' || cast(l_partkey AS string) ||
                '","metadata":{{{{"filename":"f' || cast(l_suppkey AS string) || '.png"}}}}}}}}]}}}}',
                {LINE_AT} + cast(l_quantity AS int) * 3 * {HOUR} FROM {{lineitem}}""",
            f"""SELECT 'Product', cast(p_partkey AS string), 'create', '{{{{}}}}', '{{{{}}}}',
                TIMESTAMP '2021-01-01 01:00:00' + p_size * {DAY} FROM {{part}} WHERE p_type <> 'MEDIUM'""",
            f"""SELECT 'ProductImage', cast(p_partkey * 2 AS string), 'create', '{{{{}}}}', '{{{{}}}}',
                TIMESTAMP '2020-12-20 02:00:00' + (p_partkey * 2 % 30) * {DAY} FROM {{part}}""",
            f"""SELECT 'PricingRange', cast(p_partkey * 8 + 1 AS string), 'update', '{{{{}}}}', '{{{{}}}}',
                TIMESTAMP '2020-12-25 05:00:00' + (p_partkey % 40) * {DAY} FROM {{part}}""",
        ]
    ),
}


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Role tables over the star-schema files in a folder."""

    @cache
    def base(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def build(name: str) -> DataFrame:
        text = ROLE_SQL[name]
        return spark.sql(text, **{t: base(t) for t in STAR if f"{{{t}}}" in text})

    return Tables(spark, build)


def star_sql(*roles: str) -> str:
    """The same role tables as a WITH list for a plain SQL engine."""
    names = {t: t for t in STAR}
    parts = []
    for role in roles:
        parts.append(f"{role} AS ({ROLE_SQL[role].format(**names)})")
    return ",\n".join(parts)
