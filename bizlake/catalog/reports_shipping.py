"""Registered shipping reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlake.catalog.registry import agg_text, label_sql, loc, loc_text, over, register_roles
from bizlake.functions import labels as L
from bizlake.operators.calendar import HOURS_HOLIDAYS, SLA_HOLIDAYS
from bizlake.plans import shipping

AS_OF = "2025-07-01 00:00:00"
HOURS_DAYS = ", ".join(f"DATE '{d}'" for d in HOURS_HOLIDAYS)
SLA_DAYS = ", ".join(f"DATE '{d}'" for d in SLA_HOLIDAYS)
SHIPPED = "('SHIPPING', 'DEVOLUTION_RESEND')"

register_roles(
    "r_shipments_base",
    over(
        "shipping_orders shipments shipment_items",
        f"""WITH pieces AS (
            SELECT s.shipping_order_id AS oid, sum(i.quantity) AS n
            FROM shipments s JOIN shipment_items i ON i.shipment_id = s.id WHERE s.deleted_at IS NULL GROUP BY 1),
        grain AS (
            SELECT DISTINCT o.code, o.created_at AS c, s.shipped_at AS s, o.total_kits_quantity, p.n
            FROM shipping_orders o LEFT JOIN shipments s ON s.shipping_order_id = o.id LEFT JOIN pieces p ON p.oid = o.id
            WHERE o.status NOT IN ('canceled', 'draft') AND year({loc("o.created_at")}) IN (2024, 2025) AND s.deleted_at IS NULL)
        SELECT code, {loc_text("c", "%Y-%m-%d")} AS created_at, {loc_text("s", "%Y-%m-%d")} AS shipped_at,
            total_kits_quantity, cast(n AS bigint) AS "soma_quantidade_peças", month({loc("c")}) AS "mês_created_at",
            year({loc("c")}) AS ano_created_at, month({loc("s")}) AS "mês_shipped_at", year({loc("s")}) AS ano_shipped_at,
            week({loc("c")}) AS num_semana_created_at FROM grain""",
    ),
)(shipping.shipments_base)

register_roles(
    "r_shipments_2025",
    over(
        "shipping_orders shipments shipment_items shipping_orders_followers users versions companies teams "
        "shipping_orders_customer_kits customer_kits customer_products products shipping_services",
        f"""WITH who AS (
            SELECT shipping_order_id, {agg_text("coalesce(u.first_name, '') || ' ' || coalesce(u.last_name, '')")} AS names
            FROM shipping_orders_followers f LEFT JOIN users u ON u.id = f.follower_id GROUP BY 1),
        done AS (
            SELECT item_id, min(created_at) AS at FROM versions
            WHERE item_type = 'Shipment' AND event = 'update' AND (object_changes::json->'status'->>1) = 'DELIVERED' GROUP BY 1),
        qty AS (SELECT shipment_id, sum(quantity) AS n FROM shipment_items GROUP BY 1),
        wide AS (
            SELECT s.*, o.code, o.title, o.shipping_purpose, o.created_through, o.created_at AS asked, o.shipment_expected_to AS due,
                c.name AS firm, t.name AS team, who.names AS who, k.name AS kit, cp.sku AS sku, coalesce(p.name, cp.name) AS goods,
                cp.unit_price AS unit, v.company_name AS carrier, v.name AS method, done.at AS done_at, qty.n AS pieces
            FROM shipments s JOIN shipping_orders o ON o.id = s.shipping_order_id
            LEFT JOIN shipping_services v ON v.id = s.shipping_service_id LEFT JOIN companies c ON c.id = o.company_id
            LEFT JOIN teams t ON t.id = o.team_id LEFT JOIN who ON who.shipping_order_id = o.id
            LEFT JOIN shipping_orders_customer_kits ok ON ok.shipping_order_id = o.id LEFT JOIN customer_kits k ON k.id = ok.customer_kit_id
            LEFT JOIN shipment_items i ON i.shipment_id = s.id LEFT JOIN customer_products cp ON cp.id = i.customer_product_id
            LEFT JOIN products p ON p.id = cp.product_id LEFT JOIN done ON done.item_id = cast(s.id AS varchar)
            LEFT JOIN qty ON qty.shipment_id = s.id
            WHERE lower(o.status) <> 'canceled' AND s.deleted_at IS NULL AND o.deleted_at IS NULL
              AND o.shipment_expected_to >= TIMESTAMP '2025-01-01' AND s.shipment_category IN {SHIPPED})
        SELECT code AS "Pedido de Envio", firm AS "Cliente", who AS "Solicitante", team AS "Time", title AS "Nome do Pedido de Envio",
            recipient_name AS "Destinatário", tracking_code AS "Código de Rastreio", {agg_text("kit")} AS "Kit do Cliente",
            shipping_purpose AS "Objetivo do Envio", {agg_text("sku")} AS "Skus", {agg_text("goods")} AS "Nome Produtos",
            {agg_text("shirt_size")} AS "Tamanhos",
            cast(CASE WHEN sum(unit) IS NULL OR sum(unit) = 0 THEN declared_value ELSE sum(unit) END AS double) AS "Preço",
            cast(shipment_price AS double) AS "Frete", recipient_city AS "Cidade", recipient_state AS "Estado",
            {loc_text("asked", "%d-%m-%Y")} AS "Data da Solicitação", {loc_text("due", "%d-%m-%Y")} AS "Data do Envio",
            {loc_text("due", "%m")} AS "Mês de Envio", {loc_text("due", "%Y")} AS "Ano de Envio", status AS "Status",
            created_through AS "Meio de Solicitação", cast(max(pieces) AS bigint) AS "Quantidade Total", shipment_category AS "Categoria de Envio",
            carrier AS "Transportadora", method AS "Método de Envio",
            cast(round(epoch_us(done_at - shipped_at) / 86400000000.0) AS int) AS "Tempo de Entrega em Dias"
        FROM wide GROUP BY code, due, status, firm, asked, title, recipient_name, recipient_zipcode, recipient_state, shipment_category,
            carrier, method, shipment_price, recipient_city, shipping_purpose, created_through, team, tracking_code, who, declared_value,
            recipient_street, recipient_number, recipient_complement, recipient_neighborhood, service_bill_id,
            recipient_document_number, shipped_at, done_at""",
    ),
)(shipping.shipments_detail)

SHIPPING_TYPE_SQL = over(
    "shipping_orders shipments shipment_items companies subscriptions plans versions",
    f"""WITH work AS (
        SELECT cast(d AS date) AS d, row_number() OVER (ORDER BY d) AS k
        FROM range(TIMESTAMP '2023-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) r(d)
        WHERE isodow(d) < 6 AND cast(d AS date) NOT IN ({SLA_DAYS})),
    per_trip AS (
        SELECT s.id, sum(i.quantity) AS pieces, count(DISTINCT i.customer_product_id) AS skus
        FROM shipments s LEFT JOIN shipment_items i ON i.shipment_id = s.id WHERE s.deleted_at IS NULL GROUP BY 1),
    promise AS (
        SELECT item_id, min(object_changes::json->'shipment_expected_to'->>1) AS said FROM versions
        WHERE event = 'update' AND list_contains(json_keys(object_changes), 'shipment_expected_to') GROUP BY 1),
    plan AS (
        SELECT DISTINCT u.company_id, coalesce(p.name, 'Sem Plano') AS plan FROM subscriptions u LEFT JOIN plans p ON p.id = u.plan_id),
    trip AS (
        SELECT o.code, o.id AS oid, coalesce(plan.plan, 'Sem Plano') AS plan, c.name AS firm, t.skus, t.pieces, o.total_kits_quantity AS kits,
            {loc("o.created_at")} AS made, cast({loc("s.shipped_at")} AS date) AS sent, promise.said,
            CASE WHEN t.skus = 0 THEN 'Admin - Envio Sem SKU' ELSE {label_sql("o.created_through", L.CREATED_THROUGH, "Indefinido")} END AS kind
        FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id LEFT JOIN per_trip t ON t.id = s.id
        LEFT JOIN companies c ON c.id = o.company_id LEFT JOIN plan ON plan.company_id = c.id
        LEFT JOIN promise ON promise.item_id = cast(s.id AS varchar)
        WHERE o.status NOT IN ('canceled', 'draft') AND o.created_at > TIMESTAMP '2023-01-01' AND s.deleted_at IS NULL AND s.shipped_at IS NOT NULL),
    dated AS (
        SELECT trip.*, (SELECT count(*) FROM work WHERE d BETWEEN cast(made AS date) AND sent) AS days,
            coalesce(cast(said AS date), (SELECT min(d) FROM work WHERE d >= cast(made AS date))) AS due_c,
            CASE WHEN cast(made AS time) >= TIME '18:00:00' THEN cast(made + INTERVAL 1 DAY AS date) ELSE cast(made AS date) END AS base,
            CASE WHEN kind = 'App' AND lower(plan) LIKE '%enterprise%' THEN 1 WHEN kind = 'App' AND lower(plan) LIKE '%pró%' THEN 2 ELSE 3 END AS n
        FROM trip),
    anchored AS (SELECT dated.*, (SELECT max(k) FROM work WHERE d <= base) AS k0 FROM dated),
    due AS (SELECT anchored.*, w.d AS due_o FROM anchored LEFT JOIN work w ON w.k = k0 + n),
    wrong AS (
        SELECT e.item_id, e.created_at, min(x.created_at) AS left_at FROM versions e
        JOIN versions x ON x.item_id = e.item_id AND x.created_at > e.created_at AND x.item_type = 'ShippingOrder'
            AND (x.object_changes::json->'status'->>0) = 'error'
        WHERE e.item_type = 'ShippingOrder' AND (e.object_changes::json->'status'->>-1) = 'error' GROUP BY 1, 2),
    worst AS (
        SELECT item_id, max(round(epoch_us(left_at - created_at) / 86400000000.0, 2)) AS days,
            max(round(epoch_us(left_at - created_at) / 3600000000.0, 2)) AS hours FROM wrong GROUP BY 1),
    g AS (
        SELECT code, oid, plan, firm, kind, sent, skus, min(made) AS made, min(due_c) AS due_c, min(due_o) AS due_o,
            bool_or(coalesce(sent > due_c, false)) AS late_c, bool_or(coalesce(sent > due_o AND sent > due_c, false)) AS late_o,
            max(days) AS days, sum(pieces) AS pieces, max(kits) AS kits FROM due GROUP BY ALL)
    SELECT code, oid AS shipping_order_id, plan AS "Plano", firm AS "Cliente", kind AS "Tipo Envio",
        strftime(made, '%d-%m-%Y') AS "Criado em", strftime(sent, '%d-%m-%Y') AS "Saida Efetiva (Data do Envio)",
        strftime(due_c, '%d-%m-%Y') AS "Saida esperada Cliente (data)", strftime(due_o, '%d-%m-%Y') AS "Saida Esperada Operação (data)",
        CASE WHEN late_c THEN 'sim' ELSE 'não' END AS "Atraso visão cliente (sim/não)",
        CASE WHEN late_o THEN 'sim' ELSE 'não' END AS "Atraso visão operação (sim/não)",
        g.days AS "Dias (uteis) entre criação do pedido e envio", month(made) AS "Mês de Criação", year(made) AS "Ano de Criação",
        month(sent) AS "Mês de Envio", year(sent) AS "Ano de Envio", week(made) AS num_semana_created_at, skus AS "# SKUs",
        cast(pieces AS bigint) AS soma_pecas,
        round(cast(kits AS double) * pieces / nullif(sum(pieces) OVER (PARTITION BY code), 0), 0) AS "Kits enviados",
        CASE WHEN worst.item_id IS NOT NULL THEN 'sim' ELSE 'não' END AS "Teve erro",
        worst.days AS "Tempo em erro (dias)", worst.hours AS "Tempo em erro (horas)"
    FROM g LEFT JOIN worst ON worst.item_id = cast(oid AS varchar)""",
)
register_roles("r_shipping_type_sla", SHIPPING_TYPE_SQL)(shipping.shipping_type_sla)
# Pieces once per error episode of the order.
register_roles("r_shipping_type_sla_strict", SHIPPING_TYPE_SQL.replace("FROM due GROUP BY ALL", "FROM due LEFT JOIN wrong ON wrong.item_id = cast(oid AS varchar) GROUP BY ALL"))(
    lambda t: shipping.shipping_type_sla(t, strict=True)
)

V2_SQL = f"""CASE WHEN gap = 0 THEN nullif(epoch_us(b - a), 0) / 3600e6
    WHEN gap = 1 THEN epoch_us(b - (date_trunc('day', b) + INTERVAL 9 HOUR)) / 3600e6
    WHEN gap > 1 THEN epoch_us(b - (date_trunc('day', b) + INTERVAL 9 HOUR)) / 3600e6
        + CASE WHEN hour(a) >= 18 THEN 0 ELSE epoch_us(date_trunc('day', a) + INTERVAL 18 HOUR - a) / 3600e6 END
        + 14 * len(list_filter(range(cast(a AS date) + INTERVAL 1 DAY, cast(b AS date)::timestamp, INTERVAL 1 DAY),
            lambda d: isodow(d) < 6 AND d::date NOT IN ({HOURS_DAYS}))) END"""
V2_CASE = """CASE WHEN gap = 0 AND hour(a) <= 18 THEN 1 WHEN gap = 0 THEN 2 WHEN gap = 1 AND hour(a) >= 18 THEN 3
    WHEN gap = 1 THEN 4 WHEN gap > 1 AND hour(a) >= 18 THEN 5 WHEN gap > 1 THEN 6 END"""
V1_SQL = f"""CASE WHEN gap = 0 THEN epoch_us(b - a) / 3600e6
    WHEN gap >= 1 THEN epoch_us(b - (date_trunc('day', b) + INTERVAL 9 HOUR)) / 3600e6
        + CASE WHEN cast(a AS time) > TIME '18:00:00' THEN 0 ELSE epoch_us(date_trunc('day', a) + INTERVAL 18 HOUR - a) / 3600e6 END
        + 9 * len(list_filter(range(cast(a AS date) + INTERVAL 1 DAY, cast(b AS date)::timestamp, INTERVAL 1 DAY),
            lambda d: isodow(d) < 6 AND d::date NOT IN ({HOURS_DAYS}))) END"""
V1_CASE = """CASE WHEN gap = 0 THEN CASE WHEN cast(a AS time) <= TIME '18:00:00' THEN 1 ELSE 2 END
    WHEN gap = 1 THEN CASE WHEN cast(a AS time) <= TIME '18:00:00' THEN 4 ELSE 3 END
    WHEN gap > 1 THEN CASE WHEN cast(a AS time) <= TIME '18:00:00' THEN 6 ELSE 5 END END"""


def rounded(df, *columns, digits=5):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def pairs_sql(source: str, carry: str = "") -> str:
    """Two-step pairing: pair every event with the next, then compare with the pair before."""
    extra = f", {carry}" if carry else ""
    return f"""pair AS (
            SELECT k, st AS s1, "at" AS a, lead(st) OVER w AS s2, lead("at") OVER w AS b{extra} FROM {source}
            WINDOW w AS (PARTITION BY k ORDER BY "at", st)),
        whole AS (SELECT *, date_diff('day', cast(a AS date), cast(b AS date)) AS gap FROM pair WHERE s2 IS NOT NULL AND b >= a),
        before AS (SELECT *, lag(s1) OVER w AS p1, lag(s2) OVER w AS p2 FROM whole WINDOW w AS (PARTITION BY k ORDER BY a, s1, b)),
        change AS (SELECT * FROM before WHERE (s1 <> p1 OR s2 <> p2) AND s1 <> s2)"""


register_roles(
    "r_shipping_status_times",
    over(
        "shipping_orders versions",
        f"""WITH ev AS (
            SELECT o.id AS k, o.code, v.created_at AS "at", coalesce(v.object_changes::json->'status'->>1, v.object::json->>'status') AS st
            FROM shipping_orders o JOIN versions v ON v.item_id = cast(o.id AS varchar) AND v.item_type = 'ShippingOrder'
            WHERE cast(o.created_at AS date) > DATE '2024-01-01'),
        ok AS (SELECT * FROM ev WHERE st <> ''),
        {pairs_sql("ok", "code")}
        SELECT strftime(a, '%Y-%m') AS event_month_year, {agg_text("code")} AS codes,
            {label_sql("s1", L.SHIPPING_ORDER_STATUS)} AS previous_status, {label_sql("s2", L.SHIPPING_ORDER_STATUS)} AS current_status,
            concat({label_sql("s1", L.SHIPPING_ORDER_STATUS)}, '->', {label_sql("s2", L.SHIPPING_ORDER_STATUS)}) AS variacao_status,
            a AS previous_created_at, b AS current_created_at, {V2_CASE} AS hours_between_status_case,
            round(avg({V2_SQL}), 5) AS avg_hours_between_status
        FROM change GROUP BY s1, s2, a, b, gap""",
    ),
)(lambda t: rounded(shipping.shipping_status_times(t), "avg_hours_between_status"))


register_roles(
    "r_shipping_queue",
    over(
        "shipping_orders shipments shipment_items shipping_order_items customer_products companies",
        f"""WITH a AS (
            SELECT s.shipping_order_id AS oid, sum(coalesce(i.quantity, 0)) AS q, sum(coalesce(p.unit_price, 0) * coalesce(i.quantity, 0)) AS v,
                count(DISTINCT p.sku) AS k FROM shipment_items i JOIN shipments s ON s.id = i.shipment_id
            LEFT JOIN customer_products p ON p.id = i.customer_product_id WHERE s.deleted_at IS NULL GROUP BY 1),
        b AS (
            SELECT o.id AS oid, sum(i.quantity * coalesce(o.total_kits_quantity, 1)) AS q,
                sum(coalesce(p.unit_price, 0) * i.quantity * coalesce(o.total_kits_quantity, 1)) AS v, count(DISTINCT p.sku) AS k
            FROM shipping_order_items i JOIN shipping_orders o ON o.id = i.shipping_order_id
            LEFT JOIN customer_products p ON p.id = i.customer_product_id GROUP BY 1)
        SELECT DISTINCT o.code, {loc_text("o.created_at", "%Y-%m-%d")} AS created_at,
            {loc_text("o.shipment_expected_to", "%Y-%m-%d")} AS "data_esperada_de_saída", {label_sql("o.status", L.QUEUE_STATUS)} AS status,
            c.name AS company_name, o.total_kits_quantity AS montagem, {label_sql("o.assembly_type", L.ASSEMBLY_TYPE, "desconhecido")} AS pedidos,
            coalesce(a.k, b.k, 0) AS total_skus, cast(coalesce(a.v, b.v, 0) AS double) AS total_valor_envio,
            cast(coalesce(a.q, b.q, 0) AS bigint) AS total_quantity,
            CASE WHEN o.shipment_expected_to < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'Erro'
                 WHEN o.shipment_expected_to <= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'BackLog' ELSE 'Demanda Futura' END AS tempo_de_processo
        FROM shipping_orders o LEFT JOIN a ON a.oid = o.id LEFT JOIN b ON b.oid = o.id LEFT JOIN companies c ON c.id = o.company_id
        WHERE o.shipment_expected_to IS NOT NULL AND o.status IN ({", ".join(f"'{s}'" for s in L.QUEUE_STATUS)})""",
    ),
)(lambda t: shipping.shipping_queue(t, AS_OF))

register_roles(
    "r_shipments_finance",
    over(
        "shipments shipping_services shipping_orders companies shipment_items customer_products products shipping_order_sales sales",
        f"""SELECT c.name AS "Empresa", cp.sku AS "SKU", {loc_text("s.shipped_at", "%d-%m-%Y")} AS "Data do Envio",
            {loc_text("o.created_at", "%d-%m-%Y")} AS "Data da Solicitação de Envio", {agg_text("coalesce(p.name, cp.name)")} AS "Nome Produtos",
            cast(sum(i.quantity) AS bigint) AS "Quantidade Total", {agg_text("v.company_name")} AS "Transportadoras", {agg_text("v.name")} AS "Métodos de Envio",
            {agg_text("o.code")} AS "Pedidos de Envio", s.status AS "Status do Envio", x.code AS "Código da Venda"
        FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id
        LEFT JOIN shipping_services v ON v.id = s.shipping_service_id LEFT JOIN companies c ON c.id = o.company_id
        LEFT JOIN shipment_items i ON i.shipment_id = s.id LEFT JOIN customer_products cp ON cp.id = i.customer_product_id
        LEFT JOIN products p ON p.id = cp.product_id LEFT JOIN shipping_order_sales b ON b.shipping_order_id = o.id
        LEFT JOIN sales x ON x.id = b.sale_id
        WHERE o.status <> 'canceled' AND s.deleted_at IS NULL AND o.deleted_at IS NULL AND s.shipped_at >= TIMESTAMP '2025-01-01'
          AND s.shipment_category IN {SHIPPED}
        GROUP BY c.name, cp.sku, s.shipped_at, o.created_at, s.status, x.code""",
    ),
)(shipping.shipments_finance)

register_roles(
    "r_orders_vs_finance",
    over(
        "shipments shipping_services shipping_orders companies teams shipment_items customer_products products shipping_orders_followers users",
        f"""WITH who AS (
            SELECT f.shipping_order_id AS oid, {agg_text("coalesce(u.first_name, '') || ' ' || coalesce(u.last_name, '')")} AS names
            FROM shipping_orders_followers f JOIN users u ON u.id = f.follower_id GROUP BY 1)
        SELECT o.code AS "Pedido de Envio", c.name AS "Cliente", who.names AS "Solicitante", t.name AS "Time", o.title AS "Nome do Pedido de Envio",
            s.recipient_name AS "Destinatário", s.tracking_code AS "Código de Rastreio", o.shipping_purpose AS "Objetivo do Envio",
            {agg_text("cp.sku")} AS "Skus", {agg_text("coalesce(p.name, cp.name)")} AS "Nome Produtos", {agg_text("s.shirt_size")} AS "Tamanhos",
            cast(sum(cp.unit_price) AS double) AS "Preço", cast(s.shipment_price AS double) AS "Frete", s.recipient_city AS "Cidade",
            s.recipient_state AS "Estado", {loc_text("o.created_at", "%d-%m-%Y")} AS "Data da Solicitação",
            {loc_text("o.shipment_expected_to", "%d-%m-%Y")} AS "Data do Envio", s.status AS "Status", o.created_through AS "Meio de Solicitação",
            cast(sum(i.quantity) AS bigint) AS "Quantidade Total",
            cast(sum(CASE WHEN o.assembly_type IS NULL OR o.assembly_type = 'loose_items' THEN 0 ELSE i.quantity END) AS bigint) AS "Quantidade Manuseada",
            s.recipient_zipcode AS "Endereço", s.shipment_category AS "Categoria de Envio", v.company_name AS "Transportadora",
            v.name AS "Método de Envio", max(s.days_to_deliver) AS "Dias para Entrega", s.service_bill_id
        FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id LEFT JOIN who ON who.oid = o.id
        LEFT JOIN shipping_services v ON v.id = s.shipping_service_id LEFT JOIN companies c ON c.id = o.company_id LEFT JOIN teams t ON t.id = o.team_id
        LEFT JOIN shipment_items i ON i.shipment_id = s.id LEFT JOIN customer_products cp ON cp.id = i.customer_product_id
        LEFT JOIN products p ON p.id = cp.product_id
        WHERE o.status <> 'canceled' AND o.deleted_at IS NULL AND s.deleted_at IS NULL
          AND o.shipment_expected_to >= TIMESTAMP '2024-01-01' AND s.shipment_category IN {SHIPPED}
        GROUP BY o.id, o.code, c.name, who.names, t.name, o.title, o.shipping_purpose, o.created_at, o.shipment_expected_to, o.created_through,
            s.recipient_name, s.tracking_code, s.shipment_price, s.recipient_city, s.recipient_state, s.status, s.recipient_zipcode,
            s.shipment_category, v.company_name, v.name, s.service_bill_id""",
    ),
)(shipping.orders_vs_finance)

RETURNS_SQL = over(
    "shipments shipping_services shipping_orders companies shipment_items customer_products products shipping_orders_followers users "
    "shipping_orders_customer_kits customer_kits",
    f"""WITH ev AS (
        SELECT s.id, unnest(cast(s.tracking_events AS json[])) AS e FROM shipments s WHERE s.tracking_events IS NOT NULL),
    why AS (
        SELECT id, {agg_text("e->>'description'")} AS txt FROM ev WHERE (e->>'description') ILIKE '%Objeto não entregue%' GROUP BY 1)
    SELECT c.name AS "Cliente", c.financial_email AS "E-mail do Cliente", o.code AS "Número do Pedido de Envio", o.title AS "Nome do Pedido de Envio",
        {agg_text("coalesce(u.first_name, '') || ' ' || coalesce(u.last_name, '')")} AS "Solicitante", {agg_text("u.email")} AS "E-mail do Solicitante",
        s.recipient_name AS "Destinatário", s.recipient_document_number AS "CPF/CNPJ Destinatário", s.recipient_zipcode AS "CEP",
        s.recipient_street AS "Logradouro", s.recipient_number AS "Número", s.recipient_complement AS "Complemento",
        s.recipient_neighborhood AS "Bairro", s.recipient_city AS "Cidade", s.recipient_state AS "Estado", s.recipient_email AS "E-mail do Destinatário",
        {agg_text("cp.sku")} AS "SKUs", {agg_text("p.name")} AS "Nome dos Produtos", {agg_text("s.shirt_size")} AS "Tamanhos de Camiseta",
        {agg_text("k.name")} AS "Kit do Cliente", cast(sum(i.quantity) AS bigint) AS "Quantidade Total de Itens",
        cast(sum(cp.unit_price * i.quantity) AS double) AS "Custo dos Produtos", cast(s.shipment_price AS double) AS "Frete",
        {loc_text("o.shipment_expected_to", "%d-%m-%Y")} AS "Data do Envio", s.status AS "Status", s.shipment_category AS "Categoria de Envio",
        v.company_name AS "Transportadora", v.name AS "Método de Envio", max(s.days_to_deliver) AS "Dias para Entrega",
        why.txt AS "Motivo da Devolução", {agg_text("s.tracking_code")} AS "Código de Rastreio"
    FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id LEFT JOIN why ON why.id = s.id
    LEFT JOIN shipping_services v ON v.id = s.shipping_service_id LEFT JOIN companies c ON c.id = o.company_id
    LEFT JOIN shipping_orders_customer_kits ok ON ok.shipping_order_id = o.id LEFT JOIN customer_kits k ON k.id = ok.customer_kit_id
    LEFT JOIN shipping_orders_followers f ON f.shipping_order_id = o.id LEFT JOIN users u ON u.id = f.follower_id
    LEFT JOIN shipment_items i ON i.shipment_id = s.id LEFT JOIN customer_products cp ON cp.id = i.customer_product_id
    LEFT JOIN products p ON p.id = cp.product_id
    WHERE lower(o.status) <> 'canceled' AND s.deleted_at IS NULL AND s.status IN ('PACKAGE_RETURNED', 'DEVIATION')
      AND s.updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY
    GROUP BY s.id, c.name, c.financial_email, o.code, o.title, o.shipment_expected_to, s.recipient_name, s.recipient_document_number,
        s.recipient_zipcode, s.recipient_street, s.recipient_number, s.recipient_complement, s.recipient_neighborhood, s.recipient_city,
        s.recipient_state, s.recipient_email, s.shipment_price, s.status, s.shipment_category, v.company_name, v.name, why.txt""",
)
register_roles("r_returns", RETURNS_SQL)(lambda t: shipping.returns(t, AS_OF))
register_roles("r_returns_strict", RETURNS_SQL.replace("lower(o.status) <> 'canceled'", "o.status <> 'CANCELED'"))(lambda t: shipping.returns(t, AS_OF, strict=True))
