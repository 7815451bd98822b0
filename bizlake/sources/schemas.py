"""Columns and types of the role tables, as the reports use them."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "l": T.LongType(),
    "i": T.IntegerType(),
    "b": T.BooleanType(),
    "m": T.DecimalType(18, 2),
    "r": T.DecimalType(18, 4),
    "t": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    """``name:code`` words; no code means text."""
    fields = []
    for word in text.split():
        name, _, code = word.partition(":")
        fields.append(T.StructField(name, _TYPES[code or "s"]))
    return T.StructType(fields)


# A change log stored by month has this column besides those of its role.
LOG_MONTH = "log_month"

# Identifiers are text here (uuid); numeric identifiers work as well, as long as both
# sides of a join agree. Codes: l bigint, i int, b boolean, m money, r rate, t timestamp.
ROLES: dict[str, T.StructType] = {
    name: _schema(text)
    for name, text in {
        "sales": """id code company_id quote_id status total_price:m shipment_price:m storage_price:m
            additional_value:m additional_value_description discount_value:m discount_description
            order_date:t created_at:t expected_delivery:t event_date:t deleted_at:t is_event:b turbo:b seller_id
            designer_id production_assignee_id:l payment_method number_of_installments:i storage
            redeem_page:b sample:b sold_kits_amount:i omie_order_number""",
        "sale_items": """id:l sale_id product_id customer_product_id amount:i product_price:m base_price:m
            final_price:m price_modifier_type price_modifier_value:m product_supplier_link
            personalization_areas_amount:i personalization_colors_amount:i status created_at:t""",
        "sale_item_production_infos": """sale_item_id:l purchased_quantity:i exceeding_quantity:i unit_cost:m
            customize_cost:m product_supplier_id product_customizer_id purchase_date:t
            customizer_arrival_date:t arrival_forecast_date:t filled:b buyer_id:l omie_order_code""",
        "sale_item_design_infos": "sale_item_id:l filled:b customization_type customization_colors art_size",
        "sale_item_images": "sale_item_id:l",
        "sale_status_edits": "sale_id new_status created_at:t",
        "companies": "id name cnpj employees_quantity:i credit_balance:m financial_email",
        "users": "id company_id first_name last_name email phone job_position",
        "admin_users": "id:l first_name last_name",
        "subscriptions": "company_id plan_id created_at:t",
        "plans": "id name",
        "teams": "id company_id name",
        "products": """id sku name status category_id description short_description mockup_link template_link
            internal_note tags ncm sizes_grid_id brand_id handling_range_size_id default_supplier_id
            default_customizer_id image_data credit_tax:m substitution_tax:m production_time:i
            turbo_production_time:i created_at:t updated_at:t""",
        "product_categories": "id name",
        "product_images": "id product_id image_data created_at:t",
        "pricing_ranges": "id product_id units:i markup:r product_cost:m personalization_cost:m",
        "groups": "id name active:b",
        "products_groups": "product_id group_id",
        "product_customization_prices": "product_customization_type_id quantity:i price:m markup:r",
        "product_customization_types": "id",
        "product_customization_types_products": "product_id product_customization_type_id",
        "suppliers": """id trading_name company_name document_number payment_period_in_days:i
            storage_supplier:b created_at:t updated_at:t""",
        "supplier_products": "product_id sku",
        "quotes": """id code kit_purpose designer_id:l total_price:m shipment_price:m storage_price:m
            additional_value:m additional_value_description discount_value:m discount_description
            budget_per_kit:m turbo:b created_at:t""",
        "quote_items": "id quote_id product_id amount:i final_price:m created_at:t",
        "customer_products": """id company_id product_id sizes_grid_id sku name ncm internal_note unit_price:m
            unique_inventory_amount:i""",
        "customer_product_sizes": "id customer_product_id name inventory_amount:i",
        "customer_products_inventory_addresses": "customer_product_id",
        "sizes_grids": "id",
        "inventory_moves": """id parent_id customer_product_id variant_id sale_item_id:l operation_type status
            reference_code notes quantity:i expected_quantity:i scrap_quantity:i exceeding_quantity:i
            arrived_at:t estimated_arrival_date:t created_at:t updated_at:t""",
        "loss_reports": "inventory_move_id reason quantity:i created_at:t",
        "shipping_orders": """id code title company_id team_id status created_through assembly_type
            shipping_purpose total_kits_quantity:i shipment_expected_to:t created_at:t deleted_at:t""",
        "shipping_order_items": "shipping_order_id customer_product_id quantity:i",
        "shipping_order_sales": "shipping_order_id sale_id",
        "shipping_orders_followers": "shipping_order_id follower_id",
        "shipping_orders_customer_kits": "shipping_order_id customer_kit_id",
        "customer_kits": "id name",
        "shipments": """id shipping_order_id shipping_service_id status shipment_category recipient_name
            recipient_document_number recipient_zipcode recipient_street recipient_number
            recipient_complement recipient_neighborhood recipient_city recipient_state recipient_email
            tracking_code shirt_size service_bill_id declared_value:m shipment_price:m shipment_cost:m
            days_to_deliver:i tracking_events shipped_at:t updated_at:t deleted_at:t""",
        "shipment_items": "shipment_id customer_product_id quantity:i",
        "shipping_services": "id company_name name",
        "versions": "item_type item_id event object object_changes created_at:t",
    }.items()
}
