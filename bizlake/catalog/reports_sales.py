"""Registered sales, product, customer, receipt and cohort reports."""

from __future__ import annotations

from bizlake.catalog.registry import agg_text, label_sql, loc, loc_text, over, register_roles
from bizlake.catalog.reports_shipping import AS_OF, HOURS_DAYS, V1_CASE, V1_SQL, rounded, pairs_sql
from bizlake.functions import labels as L
from bizlake.operators.status import END_STATUSES, START_STATUSES
from bizlake.plans import cohorts, customers, products, receipts, sales

DAY = "%d/%m/%Y"
BANDS = """CASE WHEN i.amount < 51 THEN 50 WHEN i.amount < 101 THEN 100 WHEN i.amount < 251 THEN 250
    WHEN i.amount < 501 THEN 500 ELSE 1000 END"""
# Order total over the sum of its live lines; 1 when that sum is not positive.
FACTOR = """factor AS (
    SELECT s.id AS sid, CASE WHEN sum(i.amount * i.final_price) <= 0 THEN 1.0
        ELSE cast(min(s.total_price) AS double) / cast(sum(i.amount * i.final_price) AS double) END AS f
    FROM sales s JOIN sale_items i ON i.sale_id = s.id WHERE s.status <> 'CANCELED' AND i.status <> 'CANCELED' GROUP BY s.id)"""
# Rows of the newest move time of each sale item, then only those with a quantity.
NEWEST = """newest AS (
    SELECT DISTINCT sale_item_id, arrived_at, expected_quantity, quantity, scrap_quantity, exceeding_quantity FROM (
        SELECT *, rank() OVER (PARTITION BY sale_item_id ORDER BY created_at DESC) AS r FROM inventory_moves WHERE sale_item_id IS NOT NULL)
    WHERE r = 1 AND quantity IS NOT NULL)"""


def yes_no(c: str, yes: str, no: str) -> str:
    return f"CASE WHEN {c} THEN '{yes}' ELSE '{no}' END"


def dbl(c: str) -> str:
    return f"cast({c} AS double)"


SALE_ROLES = (
    "sales companies sale_items sale_item_production_infos sale_item_design_infos products product_categories "
    "suppliers admin_users inventory_moves sale_status_edits"
)
LINE_JOINS = """LEFT JOIN sale_item_production_infos x ON x.sale_item_id = i.id
    LEFT JOIN sale_item_design_infos d ON d.sale_item_id = i.id
    LEFT JOIN products p ON p.id = i.product_id LEFT JOIN product_categories g ON g.id = p.category_id
    LEFT JOIN suppliers v1 ON v1.id = x.product_supplier_id LEFT JOIN suppliers v2 ON v2.id = x.product_customizer_id
    LEFT JOIN admin_users u1 ON u1.id = cast(s.seller_id AS bigint) LEFT JOIN admin_users u2 ON u2.id = cast(s.designer_id AS bigint)
    LEFT JOIN admin_users u3 ON u3.id = s.production_assignee_id"""

register_roles(
    "r_sales_margin",
    over(
        SALE_ROLES + " pricing_ranges",
        f"""WITH {FACTOR}, {NEWEST},
        started AS (SELECT sale_id, max(created_at) AS t FROM sale_status_edits WHERE new_status = 'TO_PRODUCE' GROUP BY 1),
        arrived AS (
            SELECT s.id AS sid, max(m.arrived_at) AS t FROM sales s JOIN sale_items i ON i.sale_id = s.id
            LEFT JOIN inventory_moves m ON m.sale_item_id = i.id
            WHERE s.created_at >= TIMESTAMP '2024-01-01' AND s.status <> 'CANCELED' AND i.status <> 'CANCELED' GROUP BY 1)
        SELECT s.id, s.code, i.amount AS quantidade_venda, {dbl("i.amount * i.final_price")} AS venda_final_item,
            {dbl("i.amount * i.final_price")} * factor.f AS venda_final_item_variacao,
            cast(cast({loc("s.created_at")} AS date) AS varchar) AS created_at,
            {loc_text("s.expected_delivery", DAY)} AS expected_delivery_at, {loc_text("s.event_date", DAY)} AS event_at,
            {loc_text("x.purchase_date", DAY)} AS purchase_at, {loc_text("x.customizer_arrival_date", DAY)} AS customization_at,
            {loc_text("x.arrival_forecast_date", DAY)} AS expected_arrival_at, newest.arrived_at AS arrival_at,
            {loc_text("started.t", DAY)} AS "TO_PRODUCE_AT", arrived.t AS ultima_entrega, s.status AS status_pedido, i.status AS status_produto,
            {yes_no("s.is_event", "EVENTO", "")} AS evento, {yes_no("s.turbo", "TURBO", "")} AS turbo, c.name AS client, p.sku,
            p.name AS product, g.name AS category, v1.trading_name AS supplier, v2.trading_name AS customizer,
            {dbl("x.purchased_quantity")} AS client_quantity, coalesce({dbl("x.exceeding_quantity")}, 0.0) AS exceeding_quantity,
            {dbl("x.purchased_quantity + x.exceeding_quantity")} AS production_quantity, {dbl("x.unit_cost")} AS unit_cost,
            {dbl("x.customize_cost")} AS customize_cost, {dbl("x.unit_cost + x.customize_cost")} AS product_cost,
            CASE i.price_modifier_type WHEN 'PERCENTAGE' THEN {dbl("i.price_modifier_value")} / 100 WHEN 'VALUE' THEN {dbl("i.price_modifier_value")} ELSE 0.0 END AS discount,
            {dbl("i.product_price")} AS product_price, {dbl("i.base_price")} AS base_price, {dbl("i.final_price")} AS price_with_addons,
            {dbl("newest.expected_quantity")} AS expected_quantity, {dbl("newest.quantity")} AS received_quantity,
            {dbl("newest.scrap_quantity")} AS scrap_quantity, coalesce({dbl("x.exceeding_quantity")}, 0.0) AS exceeding_quantity_2,
            u1.first_name AS seller, u3.first_name AS buyer, '' AS cadastro_turbo, {yes_no("x.filled", "CUSTO OK", "FALTA CUSTO")} AS custo_disp,
            {yes_no("d.filled", "ARTE OK", "FALTA ARTE")} AS arte_disp, d.customization_type AS tipo_personalizacao, u2.first_name AS designer,
            r.units, {dbl("r.personalization_cost")} AS personalization_cost, {dbl("r.product_cost")} AS product_cost_2, {dbl("r.markup")} AS markup,
            i.personalization_areas_amount, i.personalization_colors_amount, d.customization_colors, d.art_size, s.storage, x.buyer_id,
            x.omie_order_code, cast(cast({loc("p.created_at")} AS date) AS varchar) AS product_created_at
        FROM sales s JOIN companies c ON c.id = s.company_id JOIN sale_items i ON i.sale_id = s.id {LINE_JOINS}
        LEFT JOIN factor ON factor.sid = s.id LEFT JOIN newest ON newest.sale_item_id = i.id
        LEFT JOIN started ON started.sale_id = s.id LEFT JOIN arrived ON arrived.sid = s.id
        LEFT JOIN pricing_ranges r ON r.product_id = p.id AND p.sku IS NOT NULL AND r.units = {BANDS}
        WHERE s.created_at >= TIMESTAMP '2025-01-01' AND s.status <> 'CANCELED' AND i.status <> 'CANCELED'""",
    ),
)(sales.sales_margin)

register_roles(
    "r_year_end_sales",
    over(
        "sales companies sale_items products product_categories quotes inventory_moves",
        f"""WITH {FACTOR}, {NEWEST},
        l AS (SELECT s.*, cast({loc("s.created_at")} AS date) AS d FROM sales s)
        SELECT s.code, p.sku, p.name AS produto, g.name AS categoria, i.amount AS "quantidade vendida",
            {dbl("i.amount * i.final_price")} * f AS "valor de venda", q.kit_purpose AS "objetivo do orçamento", cast(s.d AS varchar) AS created_at
        FROM l s JOIN companies c ON c.id = s.company_id JOIN sale_items i ON i.sale_id = s.id JOIN factor ON factor.sid = s.id
        LEFT JOIN newest ON newest.sale_item_id = i.id LEFT JOIN products p ON p.id = i.product_id
        LEFT JOIN product_categories g ON g.id = p.category_id LEFT JOIN quotes q ON q.id = s.quote_id
        WHERE s.status IN ('TO_PRODUCE', 'PRODUCING', 'WAITING_PAYMENT', 'AVAILABLE_IN_INVENTORY') AND i.status <> 'CANCELED'
          AND (s.d BETWEEN DATE '2023-09-01' AND DATE '2023-12-31' OR s.d BETWEEN DATE '2024-09-01' AND DATE '2024-12-31')
          AND i.amount * i.final_price * f > 0""",
    ),
)(sales.year_end_sales)

register_roles(
    "r_repurchase",
    over(
        "sales sale_items products product_categories companies subscriptions plans",
        f"""WITH {FACTOR},
        b AS (
            SELECT s.company_id AS cid, p.sku, s.code, cast({loc("s.created_at")} AS date) AS d, p.name AS goods, g.name AS cat, i.amount AS n,
                round({dbl("i.amount * i.final_price")} * f, 2) AS v, coalesce(pl.name, 'Sem Plano') AS plan
            FROM sales s JOIN sale_items i ON i.sale_id = s.id JOIN products p ON p.id = i.product_id
            LEFT JOIN product_categories g ON g.id = p.category_id LEFT JOIN factor ON factor.sid = s.id
            LEFT JOIN subscriptions u ON u.company_id = s.company_id LEFT JOIN plans pl ON pl.id = u.plan_id
            WHERE s.status <> 'CANCELED' AND i.status <> 'CANCELED' AND p.sku IS NOT NULL)
        SELECT x.sku, x.goods AS nome_produto, c.name AS nome_empresa, x.code AS codigo_venda_original, cast(x.d AS varchar) AS data_primeira_compra,
            x.n AS quantidade_primeira, x.v AS valor_primeira, y.code AS codigo_venda_recompra, cast(y.d AS varchar) AS data_recompra,
            y.n AS quantidade_recompra, y.v AS valor_recompra, date_diff('day', x.d, y.d) AS dias_entre, x.cat AS categoria_primeira,
            y.cat AS categoria_recompra, y.plan AS plano
        FROM b x JOIN b y ON y.cid = x.cid AND y.sku = x.sku AND date_diff('day', x.d, y.d) >= 30 JOIN companies c ON c.id = x.cid""",
    ),
)(sales.repurchases)

register_roles(
    "r_purchase_governance",
    over(
        SALE_ROLES,
        f"""WITH started AS (SELECT DISTINCT sale_id, {loc_text("created_at", DAY)} AS t FROM sale_status_edits WHERE new_status = 'TO_PRODUCE')
        SELECT s.id, s.code, i.amount AS quantidade_venda, {dbl("i.amount * i.product_price")} AS venda_original,
            {dbl("i.amount * i.final_price")} AS venda_final, {loc_text("s.created_at", DAY)} AS created_at,
            {loc_text("s.expected_delivery", DAY)} AS expected_delivery_at, {loc_text("s.event_date", DAY)} AS event_at,
            {loc_text("x.purchase_date", DAY)} AS purchase_at, {loc_text("x.customizer_arrival_date", DAY)} AS customization_at,
            {loc_text("x.arrival_forecast_date", DAY)} AS expected_arrival_at, {loc_text("m.arrived_at", DAY)} AS arrival_at,
            started.t AS "TO_PRODUCE_AT", s.status AS status_pedido, i.status AS "Status_produto", {yes_no("s.is_event", "EVENTO", "")} AS "EVENTO",
            {yes_no("s.turbo", "TURBO", "")} AS "TURBO", c.name AS client, p.name AS product, g.name AS category, v1.trading_name AS supplier,
            v2.trading_name AS customizer, {dbl("x.purchased_quantity")} AS client_quantity, {dbl("x.exceeding_quantity")} AS exceeding_quantity,
            {dbl("x.purchased_quantity + x.exceeding_quantity")} AS production_quantity, {dbl("x.unit_cost")} AS unit_cost,
            {dbl("x.customize_cost")} AS customize_cost, {dbl("x.unit_cost + x.customize_cost")} AS product_cost, '' AS discount,
            {dbl("i.product_price")} AS product_price, {dbl("i.base_price")} AS base_price, {dbl("i.final_price")} AS price_with_addons,
            {dbl("m.expected_quantity")} AS expected_quantity, {dbl("m.quantity")} AS received_quantity, {dbl("m.scrap_quantity")} AS scrap_quantity,
            '' AS exceeding_quantity2, u1.first_name AS seller, u3.first_name AS buyer, x.filled AS custo_preenchido,
            {yes_no("d.filled", "ARTE OK", "FALTA ARTE")} AS arte_disp, d.customization_type AS "Tipo_personalizacao", u2.first_name AS designer,
            s.storage, x.buyer_id, x.omie_order_code
        FROM sales s JOIN companies c ON c.id = s.company_id JOIN sale_items i ON i.sale_id = s.id {LINE_JOINS}
        LEFT JOIN inventory_moves m ON m.sale_item_id = i.id LEFT JOIN started ON started.sale_id = s.id
        WHERE i.status NOT IN ('CANCELED', 'DELIVERED') AND s.status IN ('TO_PRODUCE', 'PRODUCING', 'TO_BILL')""",
    ),
)(sales.purchase_governance)

register_roles(
    "r_sales_ledger",
    over(
        "sales companies sale_items sale_item_production_infos sale_item_design_infos sale_item_images products product_categories "
        "suppliers admin_users shipments quotes",
        f"""SELECT c.name AS client_name, c.cnpj, s.omie_order_number, s.code, s.id, s.company_id,
            cast(cast({loc("s.created_at")} AS date) AS varchar) AS created_at, cast(cast({loc("s.order_date")} AS date) AS varchar) AS order_date,
            u1.first_name AS seller, u2.first_name AS designer, s.is_event, s.event_date, s.deleted_at, {dbl("s.total_price")} AS total_price,
            {dbl("s.shipment_price")} AS shipment_price, {dbl("s.storage_price")} AS storage_price, {dbl("s.additional_value")} AS additional_value,
            s.additional_value_description, {dbl("s.discount_value")} AS discount_value, s.discount_description, s.sold_kits_amount,
            'https://admin.example.org/vendas/' || s.id AS sale_link, s.payment_method, s.number_of_installments, s.storage, s.redeem_page, s.sample,
            s.status AS sale_status, p.name AS product_name, p.sku AS product_sku, g.name AS product_category, i.status AS item_status,
            {dbl("i.final_price")} AS final_price, {dbl("i.final_price * i.amount")} AS total_final_price, {dbl("x.unit_cost")} AS unit_cost,
            {dbl("(x.exceeding_quantity + x.purchased_quantity) * x.unit_cost")} AS total_cost, {dbl("x.customize_cost")} AS customize_cost,
            {dbl("(x.exceeding_quantity + x.purchased_quantity) * x.customize_cost")} AS total_customize_cost, v1.trading_name AS supplier,
            v2.trading_name AS customizer, {dbl("h.shipment_cost")} AS shipment_cost, {dbl("h.shipment_price")} AS shipment_price_charged,
            {dbl("q.total_price")} AS quote_total_price, {dbl("q.shipment_price")} AS quote_shipment_price, {dbl("q.storage_price")} AS quote_storage_price,
            {dbl("q.additional_value")} AS quote_additional_value, q.additional_value_description AS quote_additional_value_description,
            {dbl("q.discount_value")} AS quote_discount_value, q.discount_description AS quote_discount_description, q.turbo,
            {dbl("q.budget_per_kit")} AS budget_per_kit, {dbl("x.purchased_quantity")} AS client_quantity,
            {dbl("x.exceeding_quantity")} AS exceeding_quantity, {dbl("x.purchased_quantity + x.exceeding_quantity")} AS production_quantity
        FROM sales s LEFT JOIN companies c ON c.id = s.company_id LEFT JOIN sale_items i ON i.sale_id = s.id {LINE_JOINS}
        LEFT JOIN sale_item_images z ON z.sale_item_id = i.id LEFT JOIN shipments h ON h.id = s.id LEFT JOIN quotes q ON q.id = s.quote_id
        WHERE {loc("s.created_at")} BETWEEN TIMESTAMP '2025-01-01 00:00:00' AND TIMESTAMP '2025-05-14 23:59:59.999999'""",
    ),
)(sales.sales_ledger)

STATUS_TIMES_SQL = over(
    "versions sales companies sale_items customer_products products product_categories sale_item_production_infos suppliers",
    f"""WITH ev AS (
        SELECT cast(item_id AS bigint) AS k, {loc("created_at")} AS "at", object::json->>'sale_id' AS ref,
            coalesce(object_changes::json->'status'->>1, object::json->>'status') AS st
        FROM versions WHERE item_type = 'SaleItem' AND cast(created_at AS date) > DATE '2024-01-01'),
    ok AS (SELECT * FROM ev WHERE st <> ''),
    {pairs_sql("ok", "ref")},
    merged AS (
        SELECT s1, s2, a, b, gap, min(ref) AS ref, min(k) AS item, avg({V1_SQL}) AS h FROM change GROUP BY s1, s2, a, b, gap),
    span AS (
        SELECT k AS item, min(CASE WHEN st IN {START_STATUSES} THEN "at" END) AS a, max(CASE WHEN st IN {END_STATUSES} THEN "at" END) AS b
        FROM ok GROUP BY 1),
    lead_time AS (SELECT item, {V1_SQL} AS h FROM (SELECT *, date_diff('day', cast(a AS date), cast(b AS date)) AS gap FROM span WHERE b > a)),
    full_rows AS (
        SELECT m.*, s.code, {loc_text("s.created_at", "%Y-%m")} AS ym, c.name AS firm, coalesce(p1.sku, p2.sku) AS sku,
            coalesce(p1.name, p2.name) AS goods, coalesce(g1.name, g2.name) AS cat, coalesce(p1.id, p2.id) || '' || s.code AS io, i.amount,
            s.is_event, s.turbo, v.trading_name AS supplier, lead_time.h AS lead_h
        FROM merged m JOIN sales s ON s.id = cast(m.ref AS bigint) AND s.status IS DISTINCT FROM 'CANCELED'
        LEFT JOIN companies c ON c.id = s.company_id LEFT JOIN sale_items i ON i.id = m.item
        LEFT JOIN customer_products cp ON cp.id = i.customer_product_id LEFT JOIN products p1 ON p1.id = cp.product_id
        LEFT JOIN product_categories g1 ON g1.id = p1.category_id LEFT JOIN products p2 ON p2.id = i.product_id
        LEFT JOIN product_categories g2 ON g2.id = p2.category_id LEFT JOIN sale_item_production_infos x ON x.sale_item_id = m.item
        LEFT JOIN suppliers v ON v.id = x.product_supplier_id LEFT JOIN lead_time ON lead_time.item = m.item),
    kept AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY a DESC, b DESC, item DESC, s1 DESC, s2 DESC) AS r FROM full_rows WHERE ym >= '2025-01')
    SELECT '''' || strftime(a, '%Y-%m') AS event_month_year, ym AS month_year, code AS codigo_venda, firm AS nome_cliente, sku, goods AS nome_sku,
        io AS item_pedido, supplier AS fornecedor_produto, {label_sql("s1", L.SALE_ITEM_STATUS)} AS previous_status,
        {label_sql("s2", L.SALE_ITEM_STATUS)} AS current_status,
        concat({label_sql("s1", L.SALE_ITEM_STATUS)}, '->', {label_sql("s2", L.SALE_ITEM_STATUS)}) AS variacao_status,
        a AS previous_created_at, b AS current_created_at, {V1_CASE} AS hours_between_status_teste, round(h, 5) AS avg_hours_between_status,
        CASE WHEN amount <= 50 THEN '1 - Até 50' WHEN amount <= 100 THEN '2 - 51-100' WHEN amount <= 250 THEN '3 - 101-250'
            WHEN amount <= 500 THEN '4 - 251-500' WHEN amount <= 1000 THEN '5 - 501-1000' ELSE '6 - Acima de 1000' END AS faixa_unidades,
        cat AS categoria_produto,
        CASE WHEN is_event AND turbo THEN 'TURBO+EVENTO' WHEN is_event THEN 'EVENTO' WHEN turbo THEN 'TURBO' ELSE 'PADRAO' END AS "Turbo ou Evento",
        CASE WHEN r = 1 THEN round(lead_h, 5) END AS tempo_uteis_producao
    FROM kept""",
)
register_roles("r_sale_item_status_times", STATUS_TIMES_SQL)(
    lambda t: rounded(sales.sale_item_status_times(t), "avg_hours_between_status", "tempo_uteis_producao")
)
# A lead time for every start and later end.
register_roles(
    "r_sale_item_status_times_strict",
    STATUS_TIMES_SQL.replace(
        "FROM span WHERE b > a)", f"""FROM (
            SELECT x.k AS item, x."at" AS a, y."at" AS b FROM ok x JOIN ok y ON y.k = x.k AND y."at" > x."at"
            WHERE x.st IN {START_STATUSES} AND y.st IN {END_STATUSES}))"""
    ).replace("s1 DESC, s2 DESC)", "s1 DESC, s2 DESC, lead_h DESC NULLS LAST)"),
)(lambda t: rounded(sales.sale_item_status_times(t, strict=True), "avg_hours_between_status", "tempo_uteis_producao"))

register_roles(
    "r_art_control",
    over(
        "versions quote_items quotes products customer_products product_categories sales admin_users",
        f"""WITH img AS (
            SELECT DISTINCT cast(object_changes::json->'quote_item_id'->>1 AS bigint) AS qi, created_at AS t, event,
                object_changes::json->'image_data'->1->>'id' AS img, object_changes::json->'image_data'->1->'metadata'->>'filename' AS f
            FROM versions WHERE item_type = 'QuoteItemImage' AND (object_changes::json->'quote_item_id'->>1) IS NOT NULL),
        shot AS (SELECT DISTINCT i.img, i.t, i.event, i.f, q.quote_id, q.product_id FROM img i JOIN quote_items q ON q.id = i.qi WHERE q.quote_id IS NOT NULL),
        want AS (
            SELECT DISTINCT q.id, q.code, q.kit_purpose, q.created_at AS qc, i.product_id, i.created_at AS ic, coalesce(p.sku, cp.sku) AS sku,
                coalesce(p.name, cp.name) AS goods, g.name AS cat, CASE WHEN s.id IS NULL THEN 'Não' ELSE 'Sim' END AS sold,
                u.first_name || ' ' || u.last_name AS who
            FROM quotes q JOIN quote_items i ON i.quote_id = q.id LEFT JOIN products p ON p.id = i.product_id
            LEFT JOIN customer_products cp ON cp.product_id = i.product_id LEFT JOIN product_categories g ON g.id = p.category_id
            LEFT JOIN sales s ON s.quote_id = q.id LEFT JOIN admin_users u ON u.id = q.designer_id WHERE q.created_at >= TIMESTAMP '2024-01-01'),
        g AS (
            SELECT w.code, w.kit_purpose, w.sku, w.goods, w.cat, w.sold, w.qc, w.who, w.ic AS a, count(DISTINCT x.img) FILTER (x.event = 'create') AS n,
                min(x.t) FILTER (x.event = 'create') AS m1, max(x.t) FILTER (x.event = 'create') AS m2, min(x.t) AS b, {agg_text("x.f")} AS files
            FROM shot x JOIN want w ON w.id = x.quote_id AND w.product_id = x.product_id GROUP BY ALL),
        h AS (SELECT *, date_diff('day', cast(a AS date), cast(b AS date)) AS gap, epoch_us(b - (date_trunc('day', b) + INTERVAL 9 HOUR)) / 3600e6 AS op,
                epoch_us(date_trunc('day', a) + INTERVAL 18 HOUR - a) / 3600e6 AS cl FROM g WHERE n > 0)
        SELECT code AS "Código Orçamento", month(qc) AS "Mês Criação Orçamento", year(qc) AS "Ano Criação Orçamento", kit_purpose AS "Nome Orçamento",
            sku AS "SKU", goods AS "Nome Produto", cat AS "Categoria Produto", sold AS "Virou Venda", n AS "Qtd Imagens",
            m1 AS "Data Criação Primeira Imagem", m2 AS "Data Criação Última Imagem", files AS "Arquivos", who AS "Designer",
            month(m2) AS "Mês Criação Arte", year(m2) AS "Ano Criação Arte",
            round(CASE WHEN m1 < a THEN NULL WHEN gap = 0 THEN greatest(epoch_us(b - a) / 3600e6, 0)
                WHEN gap = 1 AND cast(a AS time) > TIME '18:00:00' THEN op WHEN gap = 1 THEN op + cl
                WHEN gap > 1 THEN op + cl + 9 * len(list_filter(range(cast(a AS date) + INTERVAL 1 DAY, cast(b AS date)::timestamp, INTERVAL 1 DAY),
                    lambda d: isodow(d) < 6 AND d::date NOT IN ({HOURS_DAYS}))) END, 5) AS "Tempo até Primeira Arte"
        FROM h""",
    ),
)(lambda t: rounded(sales.art_control(t), "Tempo até Primeira Arte"))

register_roles(
    "r_items_without_sku",
    over(
        "sales sale_items sale_item_production_infos customer_products products companies",
        f"""SELECT cp.name AS "Nome Produto Cliente", p.sku AS "SKU Cadastrado", p.name AS "Nome Produto Oficial",
            {loc_text("s.created_at", "%Y-%m-%d")} AS "Data da Venda", c.name AS "Cliente", x.purchased_quantity AS "Quantidade Vendida",
            {dbl("i.final_price * x.purchased_quantity")} AS "Valor da Venda", i.product_supplier_link AS "Link do Fornecedor"
        FROM sale_items i JOIN sales s ON s.id = i.sale_id JOIN customer_products cp ON cp.id = i.customer_product_id
        LEFT JOIN sale_item_production_infos x ON x.sale_item_id = i.id LEFT JOIN products p ON p.id = cp.product_id
        LEFT JOIN companies c ON c.id = s.company_id WHERE cp.name IS NOT NULL AND coalesce(p.sku, '') = ''""",
    ),
)(sales.items_without_sku)

register_roles(
    "r_product_catalog",
    over(
        "products product_categories suppliers products_groups groups sales sale_items sale_item_production_infos quotes quote_items "
        "pricing_ranges product_images",
        f"""WITH sd AS (
            SELECT i.product_id AS pid, sum(x.purchased_quantity) AS n, sum(i.final_price * x.purchased_quantity) AS v
            FROM sales s JOIN sale_items i ON i.sale_id = s.id LEFT JOIN sale_item_production_infos x ON x.sale_item_id = i.id
            WHERE s.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 6 MONTH GROUP BY 1),
        qd AS (
            SELECT i.product_id AS pid, sum(i.amount) AS n, sum(i.amount * i.final_price) AS v FROM quotes q JOIN quote_items i ON i.quote_id = q.id
            WHERE q.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 6 MONTH GROUP BY 1),
        pr AS (SELECT DISTINCT ON (product_id) * FROM pricing_ranges ORDER BY product_id, CASE WHEN units = 50 THEN 0 ELSE 1 END, units),
        pic AS (SELECT DISTINCT ON (product_id) * FROM product_images ORDER BY product_id, created_at, image_data),
        gr AS (
            SELECT p.id AS pid, {agg_text("g.name")} AS names,
                {agg_text("concat(g.name, ' (', CASE WHEN g.active THEN 'Ativo' ELSE 'Inativo' END, ')')")} AS states
            FROM products p LEFT JOIN products_groups b ON b.product_id = p.id LEFT JOIN groups g ON g.id = b.group_id GROUP BY 1)
        SELECT p.name, pic.image_data, p.created_at, p.updated_at, k.name AS category_name, p.sku, p.description, p.short_description, p.mockup_link,
            p.template_link, p.internal_note, p.tags AS tag, p.status, p.ncm, p.sizes_grid_id, p.brand_id, p.handling_range_size_id,
            v1.trading_name AS default_supplier_name, v2.trading_name AS default_customizer_name, p.id AS product_id, gr.names AS group_names,
            gr.states AS group_status, pr.units, replace(cast(pr.markup AS varchar), '.', ',') AS markup,
            replace(cast(pr.personalization_cost AS varchar), '.', ',') AS personalization_cost,
            replace(cast(pr.product_cost AS varchar), '.', ',') AS product_cost, cast(coalesce(sd.n, 0) AS bigint) AS total_quantity_sold,
            {dbl("coalesce(sd.v, 0)")} AS total_value_sold, cast(coalesce(qd.n, 0) AS bigint) AS total_quantity_quoted,
            {dbl("coalesce(qd.v, 0)")} AS total_quotes, p.production_time, p.turbo_production_time
        FROM products p LEFT JOIN product_categories k ON k.id = p.category_id LEFT JOIN suppliers v1 ON v1.id = p.default_supplier_id
        LEFT JOIN suppliers v2 ON v2.id = p.default_customizer_id LEFT JOIN gr ON gr.pid = p.id LEFT JOIN sd ON sd.pid = p.id
        LEFT JOIN qd ON qd.pid = p.id LEFT JOIN pr ON pr.product_id = p.id LEFT JOIN pic ON pic.product_id = p.id""",
    ),
)(lambda t: products.product_catalog(t, AS_OF))

register_roles(
    "r_product_first_seen",
    over(
        "versions products product_images pricing_ranges",
        f"""WITH owner AS (
            SELECT 'Product' AS kind, cast(id AS varchar) AS item, id AS pid FROM products
            UNION ALL SELECT 'ProductImage', cast(id AS varchar), product_id FROM product_images
            UNION ALL SELECT 'PricingRange', cast(id AS varchar), product_id FROM pricing_ranges)
        SELECT p.sku, strftime(min({loc("v.created_at")}), '{DAY}') AS real_create_date
        FROM versions v JOIN owner o ON o.kind = v.item_type AND o.item = v.item_id JOIN products p ON p.id = o.pid
        WHERE p.sku IS NOT NULL GROUP BY p.sku""",
    ),
)(products.product_first_seen)

register_roles(
    "r_cost_adjustments",
    over(
        "pricing_ranges products suppliers",
        f"""SELECT p.sku, p.name AS product_name, v.trading_name AS supplier_name, r.units, {dbl("r.product_cost")} AS product_cost,
            {dbl("r.markup")} AS markup, {dbl("p.credit_tax")} AS credit_tax, {dbl("p.substitution_tax")} AS substitution_tax
        FROM products p JOIN pricing_ranges r ON r.product_id = p.id JOIN suppliers v ON v.id = p.default_supplier_id
        WHERE lower(v.trading_name) NOT IN ('spot', 'asia', 'xbz')""",
    ),
)(products.cost_adjustments)

register_roles(
    "r_weekly_costs",
    over(
        "products pricing_ranges supplier_products suppliers",
        f"""SELECT p.sku, p.internal_note, r.units AS pricing_units, {dbl("r.product_cost")} AS product_cost, {dbl("r.markup")} AS markup,
            v.trading_name AS default_supplier_name, min(trim(split_part(z.sku, '-', 1))) AS supplier_sku
        FROM pricing_ranges r JOIN products p ON p.id = r.product_id AND p.status = 'ACTIVE' LEFT JOIN supplier_products z ON z.product_id = p.id
        LEFT JOIN suppliers v ON v.id = p.default_supplier_id GROUP BY p.sku, p.internal_note, r.units, r.product_cost, r.markup, v.trading_name""",
    ),
)(products.weekly_costs)

register_roles(
    "r_sku_price_grid",
    over(
        "products pricing_ranges product_customization_prices product_customization_types product_customization_types_products",
        f"""WITH f AS (
            SELECT p.sku, p.name, p.short_description AS sd, p.image_data::json->>'id' AS img, r.units,
                min(r.product_cost * r.markup + c.price * c.markup) AS v
            FROM products p JOIN pricing_ranges r ON r.product_id = p.id JOIN product_customization_types_products b ON b.product_id = p.id
            JOIN product_customization_types t ON t.id = b.product_customization_type_id
            JOIN product_customization_prices c ON c.product_customization_type_id = t.id AND c.quantity = r.units
            WHERE p.status = 'ACTIVE' AND r.units IN (50, 100, 1000) GROUP BY ALL)
        SELECT sku AS "SKU", name AS "Nome", sd AS "Descrição Curta", {dbl("max(v) FILTER (units = 50)")} AS "Preço 50 unid.",
            {dbl("max(v) FILTER (units = 100)")} AS "Preço 100 unid.", {dbl("max(v) FILTER (units = 1000)")} AS "Preço 1000 unid.",
            'https://images.example.org/store/' || img AS "Imagem" FROM f GROUP BY sku, name, sd, img""",
    ),
)(products.sku_price_grid)

register_roles(
    "r_supplier_base",
    over(
        "suppliers",
        f"""WITH l AS (SELECT *, {loc("created_at")} AS lc, cast(date_trunc('week', {loc("created_at")}) AS date) AS m FROM suppliers)
        SELECT id, trading_name, lc AS created_at, {loc("updated_at")} AS updated_at, storage_supplier, company_name, document_number,
            payment_period_in_days, cast(m AS varchar) AS semana_data,
            'Semana ' || lpad(cast(week(m) AS varchar), 2, '0') || ' - ' || strftime(m, '{DAY}') AS semana_formatada FROM l""",
    ),
)(products.supplier_base)

register_roles(
    "r_customer_success",
    over(
        "companies sales subscriptions plans shipping_orders shipments shipment_items customer_products customer_product_sizes",
        f"""WITH last AS (SELECT DISTINCT ON (company_id) * FROM sales WHERE status <> 'CANCELED' ORDER BY company_id, order_date DESC NULLS FIRST, id DESC),
        sub AS (SELECT DISTINCT ON (u.company_id) u.company_id, p.name FROM subscriptions u LEFT JOIN plans p ON p.id = u.plan_id
            ORDER BY u.company_id, u.created_at DESC NULLS FIRST, p.name DESC),
        buyer AS (SELECT DISTINCT company_id FROM sales),
        rev AS (
            SELECT company_id, sum(total_price) FILTER (year(order_date) = 2024) AS a, sum(total_price) FILTER (year(order_date) = 2025) AS b,
                sum(total_price) AS t, count(*) AS n FROM sales GROUP BY 1),
        sent AS (SELECT company_id, max(created_at) AS t FROM shipping_orders GROUP BY 1),
        stock AS (
            SELECT cp.company_id, sum(CASE WHEN z.id IS NULL THEN coalesce(cp.unique_inventory_amount, 0) ELSE coalesce(z.inventory_amount, 0) END) AS n
            FROM customer_products cp LEFT JOIN customer_product_sizes z ON z.customer_product_id = cp.id JOIN companies c ON c.id = cp.company_id
            WHERE cp.unique_inventory_amount > 0 OR z.inventory_amount > 0 GROUP BY 1),
        used AS (
            SELECT o.company_id, round(sum(i.quantity) / count(DISTINCT date_trunc('month', o.created_at)), 2) AS m
            FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id JOIN shipment_items i ON i.shipment_id = s.id
            WHERE o.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH AND o.status <> 'canceled' AND s.deleted_at IS NULL AND o.deleted_at IS NULL
              AND s.shipment_category IN ('SHIPPING', 'DEVOLUTION_RESEND') GROUP BY 1)
        SELECT c.name AS "Cliente", CASE WHEN buyer.company_id IS NOT NULL THEN sub.name END AS "Plano",
            strftime(last.order_date, '{DAY}') AS "Data Última Compra", {dbl("last.total_price")} AS "Valor Última Compra",
            'https://admin.example.org/vendas/' || last.id AS "Link Última Compra", {dbl("rev.a")} AS "Receita 2024", {dbl("rev.b")} AS "Receita 2025",
            {dbl("rev.t")} AS "Receita Total", rev.n AS "Quant. Compras", {dbl("rev.t")} / rev.n AS "Ticket Médio",
            strftime(sent.t, '{DAY}') AS "Data Último Envio", cast(stock.n AS bigint) AS "Estoque",
            CASE WHEN used.m > 0 THEN round(stock.n / used.m, 1) END AS "Giro"
        FROM companies c LEFT JOIN last ON last.company_id = c.id LEFT JOIN sub ON sub.company_id = c.id LEFT JOIN buyer ON buyer.company_id = c.id
        LEFT JOIN rev ON rev.company_id = c.id LEFT JOIN sent ON sent.company_id = c.id LEFT JOIN stock ON stock.company_id = c.id
        LEFT JOIN used ON used.company_id = c.id""",
    ),
)(lambda t: customers.customer_success(t, AS_OF))

register_roles(
    "r_customer_credit",
    over("companies", f"SELECT name, {dbl('credit_balance')} AS credit_balance FROM companies WHERE credit_balance > 0"),
)(customers.customer_credit)

register_roles(
    "r_user_directory",
    over(
        "users companies subscriptions plans",
        """SELECT concat(u.first_name, ' ', u.last_name) AS "Nome", c.name AS "Empresa", p.name AS "Plano", u.job_position AS "Posição",
            u.email AS "Email", u.phone AS "Telefone"
        FROM users u LEFT JOIN companies c ON c.id = u.company_id LEFT JOIN subscriptions s ON s.company_id = c.id LEFT JOIN plans p ON p.id = s.plan_id""",
    ),
)(customers.user_directory)

EMPLOYEES = """CASE WHEN c.employees_quantity < 50 THEN 'Menor que cinquenta' WHEN c.employees_quantity <= 300 THEN 'Entre cinquenta e trezentos'
    WHEN c.employees_quantity <= 999 THEN 'Entre trezentos e mil' ELSE 'Maior que mil' END"""
ACTIVE = "('TO_PRODUCE', 'PRODUCING', 'WAITING_PAYMENT', 'AVAILABLE_IN_INVENTORY')"
FIRST = f"""first AS (
    SELECT s.company_id AS cid, c.name AS firm, coalesce(p.name, 'Sem Plano') AS plan, {EMPLOYEES} AS band, min(s.created_at) AS t,
        year(min(s.created_at)) * 4 + quarter(min(s.created_at)) - 1 AS q0
    FROM sales s JOIN companies c ON c.id = s.company_id LEFT JOIN subscriptions u ON u.company_id = c.id LEFT JOIN plans p ON p.id = u.plan_id
    WHERE s.status IN {ACTIVE} GROUP BY s.company_id, c.name, c.employees_quantity, p.name)"""


def quarter_text(q: str) -> str:
    return f"({q}) // 4 || ' Q' || (({q}) % 4 + 1)"


register_roles(
    "r_active_usage",
    over(
        "versions users companies sales subscriptions plans",
        f"""WITH {FIRST},
        v AS (
            SELECT item_id, created_at, cast(date_trunc('week', created_at) AS date) AS w, cast(date_trunc('month', created_at) AS date) AS m FROM versions
            WHERE item_type = 'User' AND (object_changes::json->'signin_token'->>0) IS NOT NULL AND (object_changes::json->'signin_token'->>-1) IS NULL)
        SELECT c.name AS empresa, u.email AS usuario, cast(v.m AS varchar) AS mes_data, strftime(v.m, '%m/%Y') AS mes_formatado,
            cast(v.w AS varchar) AS semana_data, 'Semana ' || lpad(cast(week(v.w) AS varchar), 2, '0') || ' - ' || strftime(v.w, '{DAY}') AS semana_formatada,
            coalesce(f.plan, 'Sem Plano') AS plano, f.band AS employee_range, count(*) AS quantidade_de_acessos,
            count(*) FILTER (v.created_at >= v.w AND v.created_at < v.w + INTERVAL 7 DAY) AS acessos_na_semana
        FROM v JOIN users u ON cast(u.id AS varchar) = v.item_id JOIN companies c ON c.id = u.company_id LEFT JOIN first f ON f.cid = c.id
        WHERE v.w >= DATE '2025-05-01' GROUP BY c.id, c.name, u.id, u.email, v.m, v.w, f.plan, f.band""",
    ),
)(customers.active_usage_report)

register_roles(
    "r_stock",
    over(
        "companies teams customer_products inventory_moves sale_items products pricing_ranges customer_products_inventory_addresses "
        "customer_product_sizes product_categories sales shipments shipping_orders shipment_items",
        f"""WITH team AS (SELECT company_id, min(name) AS name FROM teams GROUP BY 1),
        origin AS (
            SELECT cp.id, CASE
                WHEN EXISTS (SELECT 1 FROM inventory_moves m WHERE m.customer_product_id = cp.id AND m.operation_type IN ('RECEIPT', 'picking'))
                 AND EXISTS (SELECT 1 FROM sale_items i WHERE i.customer_product_id = cp.id) THEN 'Comprado via Casa'
                WHEN EXISTS (SELECT 1 FROM inventory_moves m WHERE m.customer_product_id = cp.id AND m.operation_type IN ('manual_input', 'customer_input'))
                  OR NOT EXISTS (SELECT 1 FROM sale_items i WHERE i.customer_product_id = cp.id) THEN 'Recebido diretamente do cliente'
                ELSE 'Desconhecido' END AS o FROM customer_products cp),
        price AS (SELECT DISTINCT ON (product_id) product_id, product_cost * markup AS v FROM pricing_ranges WHERE units >= 50 ORDER BY product_id, units),
        placed AS (SELECT DISTINCT customer_product_id AS id FROM customer_products_inventory_addresses),
        sent AS (
            SELECT c.name AS firm, cp.sku, coalesce(s.shirt_size, 'Sem tamanho') AS size, sum(i.quantity) AS n
            FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id LEFT JOIN companies c ON c.id = o.company_id
            LEFT JOIN shipment_items i ON i.shipment_id = s.id LEFT JOIN customer_products cp ON cp.id = i.customer_product_id
            WHERE o.status <> 'canceled' AND o.deleted_at IS NULL AND s.deleted_at IS NULL
              AND o.shipment_expected_to >= cast(TIMESTAMP '{AS_OF}' AS date) - INTERVAL 90 DAY AND s.shipment_category IN ('SHIPPING', 'DEVOLUTION_RESEND')
            GROUP BY 1, 2, 3),
        moved AS (SELECT customer_product_id AS id, sum(quantity) AS n FROM inventory_moves GROUP BY 1),
        moved_size AS (SELECT customer_product_id AS id, variant_id, sum(quantity) AS n FROM inventory_moves GROUP BY 1, 2),
        wide AS (
            SELECT cp.id, z.id AS zid, c.name AS firm, team.name AS team, s.code, g.name AS cat, coalesce(p.name, cp.name) AS goods,
                coalesce(p.sku, cp.sku) AS sku, coalesce(p.ncm, cp.ncm) AS ncm, coalesce(z.name, 'Sem tamanho') AS size,
                CASE WHEN z.id IS NULL THEN coalesce(cp.unique_inventory_amount, 0) ELSE coalesce(z.inventory_amount, 0) END AS n,
                coalesce(cp.unit_price, price.v, 0) AS unit, origin.o, sent.n AS shipped, placed.id AS placed,
                CASE WHEN z.id IS NULL THEN moved.n ELSE moved_size.n END AS moved
            FROM customer_products cp LEFT JOIN customer_product_sizes z ON z.customer_product_id = cp.id LEFT JOIN products p ON p.id = cp.product_id
            LEFT JOIN price ON price.product_id = p.id LEFT JOIN product_categories g ON g.id = p.category_id LEFT JOIN companies c ON c.id = cp.company_id
            LEFT JOIN team ON team.company_id = c.id LEFT JOIN sale_items i ON i.customer_product_id = cp.id LEFT JOIN sales s ON s.id = i.sale_id
            LEFT JOIN origin ON origin.id = cp.id LEFT JOIN placed ON placed.id = cp.id LEFT JOIN moved ON moved.id = cp.id
            LEFT JOIN moved_size ON moved_size.id = cp.id AND moved_size.variant_id = z.id
            LEFT JOIN sent ON sent.firm = c.name AND sent.sku = coalesce(p.sku, cp.sku) AND sent.size = coalesce(z.name, 'Sem tamanho')
            WHERE coalesce(cp.unique_inventory_amount, 0) > 0 OR coalesce(z.inventory_amount, 0) > 0 OR coalesce(sent.n, 0) > 0)
        SELECT firm AS "Cliente", team AS "Time", code AS "Pedido", cat AS "Categoria", goods AS "Nome", sku AS "SKU", nullif(ncm, '.') AS "NCM",
            size AS "Tamanho", cast(greatest(0, sum(n)) AS bigint) AS "Estoque", {dbl("greatest(0, sum(n * unit))")} AS "Valor Estoque (R$)", o AS "Origem",
            cast(coalesce(moved, 0) AS bigint) AS "Quantidade Movimentada", cast(coalesce(shipped, 0) AS bigint) AS "Envios 90 dias",
            CASE WHEN placed IS NULL THEN 'Não Endereçado' ELSE 'Endereçado' END AS "Endereçado"
        FROM wide GROUP BY id, zid, firm, team, code, cat, goods, sku, ncm, size, o, shipped, placed, moved""",
    ),
)(lambda t: customers.stock_report(t, AS_OF))

PLAN_OF = """plan AS (
    SELECT c.id AS cid, coalesce(p.name, 'Sem Plano') AS plan FROM companies c LEFT JOIN subscriptions u ON u.company_id = c.id LEFT JOIN plans p ON p.id = u.plan_id)"""
RECEIPT_JOINS = """LEFT JOIN customer_products cp ON cp.id = m.customer_product_id LEFT JOIN companies c ON c.id = cp.company_id
    LEFT JOIN products p ON p.id = cp.product_id LEFT JOIN product_categories g ON g.id = p.category_id
    LEFT JOIN child ON child.parent_id = m.id LEFT JOIN plan ON plan.cid = c.id"""


def child_sql(excluded: str) -> str:
    return f"""child AS (
        SELECT parent_id, sum(expected_quantity) AS n FROM inventory_moves
        WHERE operation_type IN ('RECEIPT', 'customer_input') AND status NOT IN ({excluded}) GROUP BY 1)"""


RECEIVED = "coalesce(child.n, m.quantity, m.expected_quantity)"

register_roles(
    "r_receipt_history",
    over(
        "inventory_moves customer_products sale_items sale_item_production_infos suppliers companies products product_categories subscriptions plans",
        f"""WITH {child_sql("'CANCELED'")}, {PLAN_OF}
        SELECT {loc_text("m.created_at", DAY)} AS "Data_criacao", {loc_text("m.arrived_at", DAY)} AS "Data_chegada",
            {loc_text("m.arrived_at", "%m/%Y")} AS "Mes_ano_chegada",
            CASE WHEN m.operation_type = 'RECEIPT' THEN 'Recebimento Casa' ELSE 'Recebimento Terceiro' END AS "Tipo_Recebimento", c.name AS "Empresa",
            cp.sku AS "SKU", coalesce(p.name, cp.name) AS "Produto", g.name AS "Categoria", cp.internal_note AS "Venda",
            cast({RECEIVED} AS bigint) AS "Quantidade", {dbl("cp.unit_price")} AS "Valor_unitario", {dbl(RECEIVED + " * cp.unit_price")} AS "Valor_total",
            v1.trading_name AS "Fornecedor", v2.trading_name AS "Fornecedor de Personalizacao", {label_sql("m.status", L.RECEIPT_STATUS)} AS "Status",
            m.notes AS "Comentários", plan.plan AS "Plano"
        FROM inventory_moves m {RECEIPT_JOINS} LEFT JOIN sale_items i ON i.id = m.sale_item_id
        LEFT JOIN sale_item_production_infos x ON x.sale_item_id = i.id LEFT JOIN suppliers v1 ON v1.id = x.product_supplier_id
        LEFT JOIN suppliers v2 ON v2.id = x.product_customizer_id
        WHERE m.status = 'COMPLETED' AND m.operation_type IN ('RECEIPT', 'customer_input') AND m.arrived_at IS NOT NULL
          AND cast({loc_text("m.arrived_at", "%Y%m")} AS int) >= 202310""",
    ),
)(receipts.receipt_history)

register_roles(
    "r_open_receipts",
    over(
        "inventory_moves customer_products companies products product_categories subscriptions plans",
        f"""WITH {child_sql("'COMPLETED', 'CANCELED'")}, {PLAN_OF}
        SELECT {loc_text("m.created_at", DAY)} AS "Data_criacao", {loc_text("m.estimated_arrival_date", DAY)} AS data_estimada_recebimento,
            CASE WHEN m.operation_type = 'RECEIPT' THEN 'Recebimento Casa' ELSE 'Recebimento Terceiro' END AS "Tipo Recebimento", c.name AS "Empresa",
            plan.plan AS "Plano", cp.sku AS "SKU", CASE WHEN cp.product_id IS NULL THEN cp.name ELSE p.name END AS "Produto", g.name AS "Categoria",
            cp.internal_note AS "Obs_interna", m.reference_code AS "Venda", cast({RECEIVED} AS bigint) AS "Quantidade",
            {dbl("cp.unit_price")} AS "Valor_unitario", {dbl(RECEIVED + " * cp.unit_price")} AS "Valor_total",
            {label_sql("m.status", L.RECEIPT_STATUS)} AS "Status", m.notes AS "Comentários"
        FROM inventory_moves m {RECEIPT_JOINS}
        WHERE m.status NOT IN ('COMPLETED', 'CANCELED') AND m.operation_type IN ('RECEIPT', 'customer_input')""",
    ),
)(receipts.open_receipts)

register_roles(
    "r_receipt_quality_base",
    over(
        "sale_items inventory_moves customer_products companies products product_categories sale_item_production_infos suppliers",
        """WITH u AS (
            SELECT DISTINCT i.id, cp.internal_note, c.name AS firm, cp.sku, coalesce(p.name, cp.name) AS goods, g.name AS cat, i.amount,
                month(i.created_at) AS m, year(i.created_at) AS y
            FROM sale_items i LEFT JOIN inventory_moves k ON k.sale_item_id = i.id LEFT JOIN customer_products cp ON cp.id = k.customer_product_id
            LEFT JOIN companies c ON c.id = cp.company_id LEFT JOIN products p ON p.id = cp.product_id
            LEFT JOIN product_categories g ON g.id = p.category_id WHERE i.created_at >= TIMESTAMP '2024-09-01')
        SELECT internal_note AS "Código da Venda", firm AS "Cliente", sku AS "SKU", goods AS "Produto", cat AS "Categoria do Produto",
            coalesce(v1.trading_name, 'Não informado') AS "Fornecedor do Produto", coalesce(v2.trading_name, 'Não informado') AS "Fornecedor de Personalização",
            amount AS "Quantidade de Itens Vendidos", m AS "Mês", y AS "Ano"
        FROM u LEFT JOIN sale_item_production_infos x ON x.sale_item_id = u.id LEFT JOIN suppliers v1 ON v1.id = x.product_supplier_id
        LEFT JOIN suppliers v2 ON v2.id = x.product_customizer_id""",
    ),
)(receipts.receipt_quality_base)

register_roles(
    "r_loss_reports",
    over(
        "loss_reports inventory_moves sale_items sale_item_production_infos suppliers customer_products companies products product_categories",
        f"""SELECT cp.internal_note AS "Código da Venda", c.name AS "Cliente", cp.sku AS "SKU", coalesce(p.name, cp.name) AS "Produto",
            {label_sql("l.reason", L.LOSS_REASON)} AS "Razão do Relatório de Perda", l.quantity AS "Quantidade Relatada na Perda", l.created_at AS "Criado em",
            v1.trading_name AS "Fornecedor do Produto", v2.trading_name AS "Fornecedor de Personalização", g.name AS "Categoria do Produto",
            i.amount AS "Qtdade Total", month(i.created_at) AS "Mês", year(i.created_at) AS "Ano"
        FROM loss_reports l LEFT JOIN inventory_moves m ON m.id = l.inventory_move_id LEFT JOIN sale_items i ON i.id = m.sale_item_id
        LEFT JOIN sale_item_production_infos x ON x.sale_item_id = i.id LEFT JOIN suppliers v1 ON v1.id = x.product_supplier_id
        LEFT JOIN suppliers v2 ON v2.id = x.product_customizer_id LEFT JOIN customer_products cp ON cp.id = m.customer_product_id
        LEFT JOIN companies c ON c.id = cp.company_id LEFT JOIN products p ON p.id = cp.product_id LEFT JOIN product_categories g ON g.id = p.category_id""",
    ),
)(receipts.loss_reports)

register_roles(
    "r_cohort_customers",
    over(
        "sales companies subscriptions plans",
        f"""WITH {FIRST}
        SELECT f.firm AS company_name, f.plan AS plan_name, f.band AS employee_range, {quarter_text("f.q0")} AS cohort,
            year(s.created_at) || ' Q' || quarter(s.created_at) AS real_quarter
        FROM first f JOIN sales s ON s.company_id = f.cid WHERE s.status IN {ACTIVE}""",
    ),
)(cohorts.cohort_customers)

DELIVERED = """WHERE v.item_type = 'SaleItem' AND coalesce(v.object_changes::json->'status'->>1, v.object::json->>'status') = 'DELIVERED'"""

register_roles(
    "r_cohort",
    over(
        "sales companies subscriptions plans versions sale_items",
        f"""WITH {FIRST},
        ds AS (
            SELECT DISTINCT s.company_id AS cid, year(v.created_at) * 4 + quarter(v.created_at) - 1 AS q
            FROM versions v JOIN sale_items i ON i.id = cast(v.item_id AS bigint) JOIN sales s ON s.id = cast(v.object::json->>'sale_id' AS bigint) {DELIVERED}),
        sq AS (SELECT id, company_id AS cid, total_price, status, year(created_at) * 4 + quarter(created_at) - 1 AS q FROM sales WHERE status IN {ACTIVE}),
        grid AS (SELECT DISTINCT f.q0, f.plan, f.band, k.r FROM first f, range(1, 13) k(r)),
        cell AS (
            SELECT grid.*, coalesce(sum(DISTINCT sq.total_price), 0) AS rev, count(DISTINCT sq.id) AS orders, count(DISTINCT f.cid) AS firms,
                count(DISTINCT sq.cid) AS live, count(DISTINCT ds.cid) AS env,
                count(DISTINCT sq.cid) FILTER (sq.status IN ('AVAILABLE_IN_INVENTORY', 'DELIVERED')) AS ven
            FROM grid JOIN first f ON f.q0 = grid.q0 AND f.plan = grid.plan AND f.band = grid.band
            LEFT JOIN sq ON sq.cid = f.cid AND sq.q - f.q0 + 1 = grid.r LEFT JOIN ds ON ds.cid = f.cid AND ds.q - f.q0 + 1 = grid.r
            GROUP BY grid.q0, grid.plan, grid.band, grid.r)
        SELECT {quarter_text("o.q0")} AS cohort, o.r AS relative_quarter, o.plan AS plan_name, o.band AS employee_range, o.firms AS companies_in_quarter,
            o.live AS active_companies_in_quarter, o.orders AS orders_in_quarter, {dbl("o.rev")} AS revenue_in_quarter,
            cast(sum(o.orders) OVER w AS bigint) AS cumulative_orders, {dbl("sum(o.rev) OVER w")} AS cumulative_revenue, o.env AS retencao_envio, o.ven AS retencao_venda,
            round(100.0 * o.env / nullif(o.firms, 0), 2) AS retencao_envio_percentual, round(100.0 * o.ven / nullif(o.firms, 0), 2) AS retencao_venda_percentual,
            round(100.0 * {dbl("o.rev")} / nullif({dbl("b.rev")}, 0), 2) AS percentual_receita_vs_q1, {quarter_text("o.q0 + o.r - 1")} AS real_quarter
        FROM cell o JOIN cell b ON b.q0 = o.q0 AND b.plan = o.plan AND b.band = o.band AND b.r = 1
        WHERE o.q0 + o.r - 1 < year(TIMESTAMP '{AS_OF}') * 4 + quarter(TIMESTAMP '{AS_OF}') - 1
        WINDOW w AS (PARTITION BY o.q0, o.plan, o.band ORDER BY o.r)""",
    ),
)(lambda t: cohorts.cohort(t, AS_OF))

register_roles(
    "r_cohort_retention",
    over(
        "sales companies subscriptions plans versions sale_items",
        f"""WITH {FIRST},
        ds AS (
            SELECT DISTINCT s.company_id AS cid, year(v.created_at) * 4 + quarter(v.created_at) - 1 AS q
            FROM versions v JOIN sale_items i ON i.id = cast(v.item_id AS bigint) JOIN sales s ON s.id = i.sale_id {DELIVERED}),
        sq AS (
            SELECT company_id AS cid, year(created_at) * 4 + quarter(created_at) - 1 AS q, count(*) AS n, sum(total_price) AS v
            FROM sales WHERE status IN {ACTIVE} GROUP BY 1, 2),
        ac AS (SELECT f.*, k.r FROM first f, range(1, 13) k(r)),
        cell AS (
            SELECT ac.q0, ac.plan, ac.band, ac.r, count(DISTINCT ac.cid) AS firms, count(DISTINCT sq.cid) AS live, coalesce(sum(sq.n), 0) AS orders,
                coalesce(sum(sq.v), 0) AS rev, count(DISTINCT ds.cid) AS env
            FROM ac LEFT JOIN sq ON sq.cid = ac.cid AND sq.q - ac.q0 = ac.r - 1 LEFT JOIN ds ON ds.cid = ac.cid AND ds.q - ac.q0 = ac.r - 1 GROUP BY 1, 2, 3, 4),
        q1 AS (SELECT f.q0, f.plan, f.band, sum(sq.v) AS rev, count(DISTINCT f.cid) AS firms FROM first f JOIN sq ON sq.cid = f.cid AND sq.q = f.q0 GROUP BY 1, 2, 3)
        SELECT {quarter_text("o.q0")} AS cohort, o.r AS relative_quarter, o.plan AS plan_name, o.band AS employee_range, o.firms AS companies_in_quarter,
            o.live AS active_companies_in_quarter, cast(o.orders AS bigint) AS orders_in_quarter, {dbl("o.rev")} AS revenue_in_quarter,
            cast(sum(o.orders) OVER w AS bigint) AS cumulative_orders, {dbl("sum(o.rev) OVER w")} AS cumulative_revenue, o.env AS retencao_envio, o.live AS retencao_venda,
            {dbl("q1.rev")} AS revenue_q1, q1.firms AS base_companies_in_q1
        FROM cell o JOIN q1 ON q1.q0 = o.q0 AND q1.plan = o.plan AND q1.band = o.band
        WHERE q1.rev > 0 AND o.q0 + o.r - 1 < year(TIMESTAMP '{AS_OF}') * 4 + quarter(TIMESTAMP '{AS_OF}') - 1
        WINDOW w AS (PARTITION BY o.q0, o.plan, o.band ORDER BY o.r)""",
    ),
)(lambda t: cohorts.cohort_retention_report(t, AS_OF))
