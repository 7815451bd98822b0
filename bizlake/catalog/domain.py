"""Registered domain operators, over the role tables of the star schema."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bizlake.catalog.registry import agg_text, label_sql, loc, over, read, register, register_roles
from bizlake.catalog.reports_sales import ACTIVE, DELIVERED, EMPLOYEES, FACTOR, FIRST, dbl, quarter_text
from bizlake.catalog.reports_shipping import (
    AS_OF, HOURS_DAYS, SLA_DAYS, V1_CASE, V1_SQL, V2_CASE, V2_SQL, rounded, pairs_sql,
)
from bizlake.functions import labels as L
from bizlake.functions.text import matching_descriptions
from bizlake.functions.time import day, local_ts, quarter_label, week_label
from bizlake.operators import calendar as C
from bizlake.operators import changelog as G
from bizlake.operators import cohort as K
from bizlake.operators import hours as H
from bizlake.operators import keys, orders, pricing, repurchase, status, stock, usage
from bizlake.operators.ordered import SLICE, sliced
from bizlake.plans.common import pick

WORK = f"""work AS (
    SELECT cast(d AS date) AS d, row_number() OVER (ORDER BY d) AS k FROM range(TIMESTAMP '2023-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) r(d)
    WHERE isodow(d) < 6 AND cast(d AS date) NOT IN ({SLA_DAYS}))"""
ITEM_EVENTS = f"""ev AS MATERIALIZED (
    SELECT item_id AS k, {loc("created_at")} AS "at", coalesce(object_changes::json->'status'->>1, object::json->>'status') AS st
    FROM versions WHERE item_type = 'SaleItem')"""


def _item_events(t):
    return G.unpack_changes(G.log_of(t.versions, "SaleItem"), "status").select(
        F.col("item_id").alias("item"), local_ts("created_at").alias("at"), F.col("value").alias("status")
    )


def _cut_item_events(t, *ties):
    """The same events in slices of an item's time, which are found on plain columns before anything is parsed."""
    log = G.log_of(t.versions, "SaleItem").withColumns({"item": F.col("item_id"), "at": local_ts("created_at")})
    if ties:
        log = log.withColumn("_tie", F.xxhash64(*ties))
    log = sliced(log, ["item"], ["at", "_tie"] if ties else ["at"])
    return G.unpack_changes(log, "status", keep=["item", "at", SLICE]).select("item", "at", F.col("value").alias("status"), SLICE)


@register_roles(
    "d_business_calendar",
    over(
        "sales",
        f"""WITH days AS (SELECT cast(d AS date) AS d FROM range(TIMESTAMP '2019-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) r(d)),
        flag AS (SELECT d, isodow(d) < 6 AND d NOT IN ({SLA_DAYS}) AS is_bd FROM days),
        n AS (SELECT cast(order_date AS date) AS d, count(*) AS orders FROM sales GROUP BY 1)
        SELECT cast(d AS varchar) AS day, is_bd, cast(sum(cast(is_bd AS int)) OVER (ORDER BY d) AS int) AS bd_idx, coalesce(orders, 0) AS orders
        FROM flag LEFT JOIN n USING (d)""",
    ),
)
def _calendar(t):
    days = C.business_calendar(t.spark, date(2019, 1, 1), date(2025, 12, 31))
    counts = t.sales.groupBy(day("order_date").alias("day")).agg(F.count("*").alias("orders"))
    return days.join(counts, "day", "left").select("day", "is_bd", "bd_idx", F.coalesce("orders", F.lit(0)).alias("orders"))


@register_roles(
    "d_business_days_between",
    over(
        "sales shipments",
        f"""WITH {WORK}, span AS (SELECT DISTINCT cast(s.created_at AS date) AS a, cast(h.shipped_at AS date) AS b
            FROM shipments h JOIN sales s ON s.id = h.shipping_order_id),
        counted AS (SELECT a, b, count(work.d) AS n FROM span LEFT JOIN work ON work.d BETWEEN a AND b GROUP BY a, b)
        SELECT h.id AS shipment_id, cast(a AS varchar) AS created_on, cast(b AS varchar) AS shipped_on, cast(n AS int) AS work_days
        FROM shipments h JOIN sales s ON s.id = h.shipping_order_id
        JOIN counted ON a = cast(s.created_at AS date) AND b IS NOT DISTINCT FROM cast(h.shipped_at AS date)""",
    ),
)
def _between(t):
    made = pick(t.sales, id="shipping_order_id", created_at="created_at")
    rows = t.shipments.select(F.col("id").alias("shipment_id"), "shipping_order_id", "shipped_at").join(made, "shipping_order_id")
    return rows.select(
        "shipment_id", day("created_at").alias("created_on"), day("shipped_at").alias("shipped_on"),
        C.business_days_between("created_at", "shipped_at").alias("work_days"),
    )


@register_roles(
    "d_sla_due_date",
    over(
        "sales subscriptions plans",
        f"""WITH {WORK}, r AS (
            SELECT s.id, s.created_at AS t, coalesce(p.name, 'Sem Plano') AS plan, CASE WHEN s.is_event THEN 'App' ELSE 'Resgate' END AS kind
            FROM sales s LEFT JOIN (SELECT DISTINCT u.company_id, p.name FROM subscriptions u LEFT JOIN plans p ON p.id = u.plan_id) p ON p.company_id = s.company_id),
        n AS (
            SELECT *, CASE WHEN kind <> 'App' THEN 3 WHEN lower(plan) LIKE '%enterprise%' THEN 1 WHEN lower(plan) LIKE '%pró%' THEN 2 ELSE 3 END AS n,
                cast(CASE WHEN hour(t) >= 18 THEN t + INTERVAL 1 DAY ELSE t END AS date) AS base FROM r),
        top AS (SELECT x.base, max(k) AS k0 FROM (SELECT DISTINCT base FROM n) x JOIN work ON work.d <= x.base GROUP BY 1)
        SELECT id, plan AS plan_name, kind, n AS promised_days, cast(work.d AS varchar) AS due_on
        FROM n LEFT JOIN top USING (base) LEFT JOIN work ON work.k = k0 + n""",
    ),
)
def _due(t):
    rows = K.with_plan(
        t.sales.select("id", "company_id", "created_at", F.when(F.col("is_event"), "App").otherwise("Resgate").alias("kind")),
        t.subscriptions, t.plans,
    ).withColumn("promised_days", C.plan_sla_days("plan_name", "kind"))
    return C.sla_due_date(rows, "created_at", "promised_days", "due_on").select("id", "plan_name", "kind", "promised_days", "due_on")


@register_roles(
    "d_next_business_day",
    over(
        "sales",
        f"""WITH {WORK}, d0 AS (SELECT DISTINCT cast(created_at AS date) AS a FROM sales),
        nxt AS (SELECT a, min(work.d) AS b FROM d0 LEFT JOIN work ON work.d >= a GROUP BY a)
        SELECT id, cast(b AS varchar) AS next_day FROM sales JOIN nxt ON a = cast(created_at AS date)""",
    ),
)
def _next_day(t):
    return C.next_business_day(t.sales.select("id", "created_at"), "created_at", "next_day").select("id", "next_day")


@register(
    "d_status_pairs",
    f"""WITH ok AS (SELECT user_id AS k, ts AS "at", event_type AS st FROM events WHERE event_type <> ''), {pairs_sql("ok")}
    SELECT k AS user_id, s1 AS previous_status, s2 AS current_status, a AS previous_at, b AS current_at FROM change""",
)
def _pairs(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return status.status_pairs(events, "user_id")


@register_roles(
    "d_status_labels",
    over(
        "sale_items shipping_orders inventory_moves loss_reports",
        f"""WITH codes AS (
            SELECT 'item' AS kind, status AS code, {label_sql("status", L.SALE_ITEM_STATUS)} AS label FROM sale_items
            UNION ALL SELECT 'shipping', status, {label_sql("status", L.SHIPPING_ORDER_STATUS)} FROM shipping_orders
            UNION ALL SELECT 'queue', status, {label_sql("status", L.QUEUE_STATUS)} FROM shipping_orders
            UNION ALL SELECT 'receipt', status, {label_sql("status", L.RECEIPT_STATUS)} FROM inventory_moves
            UNION ALL SELECT 'loss', reason, {label_sql("reason", L.LOSS_REASON)} FROM loss_reports
            UNION ALL SELECT 'assembly', assembly_type, {label_sql("assembly_type", L.ASSEMBLY_TYPE, "desconhecido")} FROM shipping_orders)
        SELECT kind, code, label, count(*) AS n FROM codes GROUP BY 1, 2, 3""",
    ),
)
def _labels(t):
    def coded(df, kind, c, labels, default=None):
        return df.groupBy(F.col(c).alias("code")).agg(F.count("*").alias("n")).select(
            F.lit(kind).alias("kind"), "code", L.map_labels("code", labels, default).alias("label"), "n"
        )

    parts = [
        coded(t.sale_items, "item", "status", L.SALE_ITEM_STATUS),
        coded(t.shipping_orders, "shipping", "status", L.SHIPPING_ORDER_STATUS),
        coded(t.shipping_orders, "queue", "status", L.QUEUE_STATUS),
        coded(t.inventory_moves, "receipt", "status", L.RECEIPT_STATUS),
        coded(t.loss_reports, "loss", "reason", L.LOSS_REASON),
        coded(t.shipping_orders, "assembly", "assembly_type", L.ASSEMBLY_TYPE, "desconhecido"),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _hours(case_fn, hours_fn):
    def build(spark, sf_dir):
        events = read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("status"))
        changes = status.status_pairs(events, "user_id")
        return changes.select(
            "user_id", "previous_at", "current_at", case_fn("previous_at", "current_at").alias("branch"),
            F.round(hours_fn("previous_at", "current_at"), 5).alias("hours"),
        )

    return build


for _key, _case, _sql, _fns in (
    ("d_business_hours", V1_CASE, V1_SQL, (H.business_hours_case, H.business_hours)),
    ("d_business_hours_v2", V2_CASE, V2_SQL, (H.clock_hours_case, H.clock_hours)),
):
    register(
        _key,
        f"""WITH ok AS (SELECT user_id AS k, ts AS "at", event_type AS st FROM events), {pairs_sql("ok")}
        SELECT k AS user_id, a AS previous_at, b AS current_at, {_case} AS branch, round({_sql}, 5) AS hours FROM change""",
    )(_hours(*_fns))


@register_roles(
    "d_first_art_hours",
    over(
        "sale_items shipments",
        f"""WITH x AS (
            SELECT i.sale_id, min(i.created_at) AS a, min(h.updated_at) AS b, min(h.updated_at) FILTER (h.status <> 'SHIPPED') AS m1
            FROM sale_items i JOIN shipments h ON h.id = i.id GROUP BY 1),
        g AS (SELECT *, date_diff('day', cast(a AS date), cast(b AS date)) AS gap, epoch_us(b - (date_trunc('day', b) + INTERVAL 9 HOUR)) / 3600e6 AS op,
            epoch_us(date_trunc('day', a) + INTERVAL 18 HOUR - a) / 3600e6 AS cl FROM x)
        SELECT sale_id, round(CASE WHEN m1 < a THEN NULL WHEN gap = 0 THEN greatest(epoch_us(b - a) / 3600e6, 0)
            WHEN gap = 1 THEN op + CASE WHEN cast(a AS time) > TIME '18:00:00' THEN 0 ELSE cl END
            WHEN gap > 1 THEN op + cl + 9 * len(list_filter(range(cast(a AS date) + INTERVAL 1 DAY, cast(b AS date)::timestamp, INTERVAL 1 DAY),
                lambda d: isodow(d) < 6 AND d::date NOT IN ({HOURS_DAYS}))) END, 5) AS hours FROM g""",
    ),
)
def _first_art(t):
    sent = t.shipments.select("id", "updated_at", "status")
    g = t.sale_items.select("id", "sale_id", "created_at").join(sent, "id").groupBy("sale_id").agg(
        F.min("created_at").alias("asked"), F.min("updated_at").alias("answered"),
        F.min(F.when(F.col("status") != "SHIPPED", F.col("updated_at"))).alias("valid"),
    )
    return g.select("sale_id", F.round(H.first_response_hours("asked", "answered", "valid"), 5).alias("hours"))


@register_roles(
    "d_latest_per_key",
    over(
        "inventory_moves",
        """WITH r AS (SELECT *, rank() OVER (PARTITION BY sale_item_id ORDER BY created_at DESC) AS r FROM inventory_moves)
        SELECT id, sale_item_id, created_at, quantity FROM r WHERE r = 1 AND quantity IS NOT NULL""",
    ),
)
def _latest(t):
    moves = t.inventory_moves.select("id", "sale_item_id", "created_at", "quantity")
    return keys.latest_per_key(moves, ["sale_item_id"], "created_at", F.col("quantity").isNotNull())


@register_roles(
    "d_latest_subscription",
    over(
        "sales subscriptions plans",
        """WITH b AS (SELECT DISTINCT company_id FROM sales),
        r AS (SELECT u.company_id, p.name, row_number() OVER (PARTITION BY u.company_id ORDER BY u.created_at DESC, p.name DESC) AS r
            FROM subscriptions u LEFT JOIN plans p ON p.id = u.plan_id)
        SELECT b.company_id, r.name AS plan_name FROM b LEFT JOIN r ON r.company_id = b.company_id AND r.r = 1""",
    ),
)
def _subscription(t):
    return keys.latest_subscription(t.sales, t.subscriptions, t.plans)


@register_roles(
    "d_latest_purchase",
    over(
        "sales",
        f"""SELECT DISTINCT ON (company_id) company_id, id, order_date, {dbl("total_price")} AS total_price FROM sales
        WHERE status <> 'CANCELED' ORDER BY company_id, order_date DESC NULLS FIRST, id DESC""",
    ),
)
def _purchase(t):
    return keys.latest_purchase(t.sales)


@register_roles(
    "d_first_transition",
    over(
        "versions",
        """SELECT item_id, min(created_at) AS reached_at FROM versions WHERE item_type = 'Shipment' AND event = 'update'
        AND json_extract_string(object_changes, '$.status[1]') = 'DELIVERED' GROUP BY 1""",
    ),
)
def _transition(t):
    return G.first_transition(t.versions, "Shipment", "DELIVERED")


@register_roles(
    "d_changelog",
    over(
        "versions",
        """SELECT item_id, created_at, event, object_changes::json->'status'->>0 AS old_value, object_changes::json->'status'->>1 AS new_value,
            object_changes::json->'status'->>-1 AS last_value,
            coalesce(object_changes::json->'status'->>1, object::json->>'status') AS value, object::json->>'sale_id' AS sale_id
        FROM versions WHERE item_type IN ('SaleItem', 'ShippingOrder')""",
    ),
)
def _changelog(t):
    return G.unpack_changes(G.log_of(t.versions, "SaleItem", "ShippingOrder"), "status", ["sale_id"])


@register_roles(
    "d_error_episodes",
    over(
        "versions",
        """WITH e AS (SELECT item_id, created_at AS t FROM versions WHERE item_type = 'ShippingOrder' AND (object_changes::json->'status'->>-1) = 'error'),
        x AS (SELECT item_id, created_at AS t FROM versions WHERE item_type = 'ShippingOrder' AND (object_changes::json->'status'->>0) = 'error')
        SELECT e.item_id, e.t AS entered_at, min(x.t) AS left_at, round(epoch_us(min(x.t) - e.t) / 86400e6, 2) AS days,
            round(epoch_us(min(x.t) - e.t) / 3600e6, 2) AS hours FROM e JOIN x ON x.item_id = e.item_id AND x.t > e.t GROUP BY 1, 2""",
    ),
)
def _episodes(t):
    return G.error_episodes(t.versions)


@register_roles(
    "d_stage_lead_time",
    over(
        "versions",
        f"""WITH {ITEM_EVENTS},
        o AS MATERIALIZED (SELECT k, st AS s1, "at" AS a, cast("at" AS date) AS da FROM ev WHERE st IN {status.START_STATUSES}),
        c AS MATERIALIZED (SELECT k, st AS s2, "at" AS b, cast("at" AS date) AS db FROM ev WHERE st IN {status.END_STATUSES}),
        cal AS MATERIALIZED (
            SELECT d, sum(CASE WHEN isodow(d) < 6 AND d NOT IN ({HOURS_DAYS}) THEN 1 ELSE 0 END) OVER (ORDER BY d) AS n
            FROM (SELECT cast(d AS date) AS d FROM range(TIMESTAMP '2018-12-01', TIMESTAMP '2027-01-01', INTERVAL 1 DAY) r(d))),
        p AS (
            SELECT o.k, s1, a, da, s2, b, db, cb.n - CASE WHEN isodow(db) < 6 AND db NOT IN ({HOURS_DAYS}) THEN 1 ELSE 0 END - ca.n AS between_days
            FROM o JOIN c ON c.k = o.k JOIN cal ca ON ca.d = da JOIN cal cb ON cb.d = db WHERE b > a)
        SELECT k AS item, s1 AS start_status, a AS started_at, s2 AS end_status, b AS ended_at,
            round(CASE WHEN da = db THEN epoch_us(b - a) / 3600e6 ELSE epoch_us(b - (date_trunc('day', b) + INTERVAL 9 HOUR)) / 3600e6
                + CASE WHEN cast(a AS time) > TIME '18:00:00' THEN 0 ELSE epoch_us(date_trunc('day', a) + INTERVAL 18 HOUR - a) / 3600e6 END
                + 9 * CASE WHEN db - da > 1 THEN between_days ELSE 0 END END, 5) AS working_hours FROM p""",
    ),
)
def _lead(t):
    return rounded(status.stage_lead_time(_cut_item_events(t, "object_changes"), "item"), "working_hours")


@register_roles(
    "d_next_end",
    over(
        "versions",
        f"""WITH {ITEM_EVENTS},
        o AS (SELECT DISTINCT k, st AS s1, "at" AS a FROM ev WHERE st IN {status.START_STATUSES}),
        c AS (SELECT k, "at" AS b, min(st) AS s2 FROM ev WHERE st IN {status.END_STATUSES} GROUP BY 1, 2),
        p AS (SELECT o.k, s1, a, s2, b, date_diff('day', cast(a AS date), cast(b AS date)) AS gap FROM o ASOF LEFT JOIN c ON c.k = o.k AND c.b > o.a)
        SELECT k AS item, s1 AS start_status, a AS started_at, s2 AS end_status, b AS ended_at, round({V1_SQL}, 5) AS working_hours FROM p""",
    ),
)
def _next_end(t):
    return rounded(status.next_end(_cut_item_events(t), "item"), "working_hours")


@register_roles(
    "d_stage_span",
    over(
        "versions",
        f"""WITH {ITEM_EVENTS}, s AS (
            SELECT k, min("at") FILTER (st IN {status.START_STATUSES}) AS a, max("at") FILTER (st IN {status.END_STATUSES}) AS b FROM ev GROUP BY 1),
        g AS (SELECT *, date_diff('day', cast(a AS date), cast(b AS date)) AS gap FROM s WHERE b > a)
        SELECT k AS item, a AS started_at, b AS ended_at, round({V1_SQL}, 5) AS working_hours FROM g""",
    ),
)
def _span(t):
    return rounded(status.stage_span(_item_events(t), "item"), "working_hours")


@register_roles(
    "d_first_seen",
    over(
        "versions products product_images",
        f"""WITH o AS (SELECT 'Product' AS kind, cast(id AS varchar) AS item, id AS pid FROM products
            UNION ALL SELECT 'ProductImage', cast(id AS varchar), product_id FROM product_images)
        SELECT p.sku, min({loc("v.created_at")}) AS first_seen_at, strftime(min({loc("v.created_at")}), '%d/%m/%Y') AS first_seen_on
        FROM versions v JOIN o ON o.kind = v.item_type AND o.item = v.item_id JOIN products p ON p.id = o.pid WHERE p.sku IS NOT NULL GROUP BY 1""",
    ),
)
def _seen(t):
    text = F.col("id").cast("string").alias("item_id")
    owners = {
        "Product": t.products.select(text, F.col("id").alias("product_id")),
        "ProductImage": t.product_images.select(text, "product_id"),
    }
    return G.first_seen(t.versions, owners, t.products)


@register_roles(
    "d_active_usage",
    over(
        "versions",
        """WITH v AS (SELECT item_id, cast(date_trunc('month', created_at) AS date) AS m, cast(date_trunc('week', created_at) AS date) AS w, created_at
            FROM versions WHERE item_type = 'User' AND (object_changes::json->'signin_token'->>0) IS NOT NULL
            AND (object_changes::json->'signin_token'->>-1) IS NULL)
        SELECT item_id, cast(m AS varchar) AS "month", cast(w AS varchar) AS week, count(*) AS accesses,
            count(*) FILTER (created_at >= w AND created_at < w + INTERVAL 7 DAY) AS accesses_in_week
        FROM v WHERE w >= DATE '2025-05-01' GROUP BY 1, 2, 3""",
    ),
)
def _usage(t):
    return usage.active_usage(t.versions)


@register_roles(
    "d_alloc_factor",
    over(
        "sales sale_items",
        f"""WITH {FACTOR} SELECT i.id, i.sale_id, {dbl("i.amount * i.final_price")} AS line_value, f AS factor,
            {dbl("i.amount * i.final_price")} * f AS allocated_value FROM sale_items i LEFT JOIN factor ON sid = i.sale_id""",
    ),
)
def _alloc(t):
    return pricing.allocate(t.sales, t.sale_items).select("id", "sale_id", "line_value", "factor", "allocated_value")


@register_roles(
    "d_volume_band_price",
    over(
        "sale_items pricing_ranges",
        f"""WITH l AS (SELECT id, amount, product_id, CASE WHEN amount < 51 THEN 50 WHEN amount < 101 THEN 100 WHEN amount < 251 THEN 250
            WHEN amount < 501 THEN 500 ELSE 1000 END AS band FROM sale_items)
        SELECT l.id, l.amount, l.product_id, l.band, {dbl("r.product_cost")} AS product_cost, {dbl("r.markup")} AS markup
        FROM l LEFT JOIN pricing_ranges r ON r.product_id = l.product_id AND r.units = l.band""",
    ),
)
def _band_price(t):
    lines = t.sale_items.select("id", "amount", "product_id")
    return pricing.band_lookup(lines, t.pricing_ranges).select("id", "amount", "product_id", "band", "product_cost", "markup")


@register_roles(
    "d_band_label",
    over(
        "sale_items companies",
        f"""SELECT 'quantity' AS kind, CASE WHEN amount <= 50 THEN '1 - Até 50' WHEN amount <= 100 THEN '2 - 51-100' WHEN amount <= 250 THEN '3 - 101-250'
            WHEN amount <= 500 THEN '4 - 251-500' WHEN amount <= 1000 THEN '5 - 501-1000' ELSE '6 - Acima de 1000' END AS label, count(*) AS n
        FROM sale_items GROUP BY 2 UNION ALL SELECT 'employees', {EMPLOYEES}, count(*) FROM companies c GROUP BY 2""",
    ),
)
def _band_label(t):
    a = t.sale_items.groupBy(F.lit("quantity").alias("kind"), L.quantity_band("amount").alias("label")).agg(F.count("*").alias("n"))
    b = t.companies.groupBy(F.lit("employees").alias("kind"), L.employee_band("employees_quantity").alias("label")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


@register_roles(
    "d_repurchase",
    over(
        "sales sale_items",
        """WITH b AS (SELECT s.company_id, i.product_id, cast(s.created_at AS date) AS d, s.code, i.amount FROM sale_items i JOIN sales s ON s.id = i.sale_id)
        SELECT x.company_id, x.product_id, cast(x.d AS varchar) AS first_bought_on, x.code AS first_code, x.amount AS first_amount,
            cast(y.d AS varchar) AS again_bought_on, y.code AS again_code, y.amount AS again_amount, date_diff('day', x.d, y.d) AS days_between
        FROM b x JOIN b y ON y.company_id = x.company_id AND y.product_id = x.product_id AND date_diff('day', x.d, y.d) >= 30""",
    ),
)
def _repurchase(t):
    heads = t.sales.select(F.col("id").alias("sale_id"), "company_id", "code", day("created_at").alias("bought_on"))
    rows = t.sale_items.select("sale_id", "product_id", "amount").join(heads, "sale_id")
    return repurchase.repurchase(rows, ["company_id", "product_id"], "bought_on", ["code", "amount"])


@register_roles(
    "d_cohort_first",
    over(
        "sales companies subscriptions plans",
        f"""WITH {FIRST} SELECT cid AS company_id, firm AS company_name, plan AS plan_name, band AS employee_range, t AS first_order_at,
            q0 AS cohort_idx, {quarter_text("q0")} AS cohort FROM first""",
    ),
)
def _cohort_first(t):
    first = K.cohort_first(t.sales, t.companies, t.subscriptions, t.plans)
    return first.withColumn("cohort", quarter_label("cohort_idx"))


GRID_SQL = f"""WITH {FIRST},
    ds AS (SELECT DISTINCT s.company_id AS cid, year(v.created_at) * 4 + quarter(v.created_at) - 1 AS q
        FROM versions v JOIN sale_items i ON i.id = cast(v.item_id AS bigint) JOIN sales s ON s.id = i.sale_id {DELIVERED}),
    sq AS (SELECT id, company_id AS cid, total_price, year(created_at) * 4 + quarter(created_at) - 1 AS q FROM sales WHERE status IN {ACTIVE}),
    ac AS (SELECT f.*, k.r FROM first f, range(1, 13) k(r) WHERE f.q0 + k.r - 1 < year(TIMESTAMP '{AS_OF}') * 4 + quarter(TIMESTAMP '{AS_OF}') - 1)"""


@register_roles(
    "d_cohort_matrix",
    over(
        "sales companies subscriptions plans versions sale_items",
        f"""{GRID_SQL} SELECT ac.q0 AS cohort_idx, ac.plan AS plan_name, ac.band AS employee_range, ac.r AS relative_quarter,
            {dbl("coalesce(sum(DISTINCT sq.total_price), 0)")} AS revenue_in_quarter, count(DISTINCT sq.id) AS orders_in_quarter,
            count(DISTINCT ds.cid) AS retencao_envio
        FROM ac LEFT JOIN sq ON sq.cid = ac.cid AND sq.q = ac.q0 + ac.r - 1 LEFT JOIN ds ON ds.cid = ac.cid AND ds.q = ac.q0 + ac.r - 1 GROUP BY 1, 2, 3, 4""",
    ),
)
def _matrix(t):
    members = K.cohort_first(t.sales, t.companies, t.subscriptions, t.plans)
    delivered = K.delivered_quarters(G.deliveries(t.versions), t.sales, t.sale_items, "item")
    return K.cohort_matrix(members, t.sales, delivered, AS_OF).select(
        *K.CELL, "relative_quarter", "revenue_in_quarter", "orders_in_quarter", "retencao_envio"
    )


@register_roles(
    "d_cohort_retention",
    over(
        "sales companies subscriptions plans versions sale_items",
        f"""{GRID_SQL}, c AS (
            SELECT ac.q0, ac.plan, ac.band, ac.r, count(DISTINCT ac.cid) AS firms, count(DISTINCT sq.cid) AS live, coalesce(sum(sq.total_price), 0) AS rev
            FROM ac LEFT JOIN sq ON sq.cid = ac.cid AND sq.q = ac.q0 + ac.r - 1 GROUP BY 1, 2, 3, 4)
        SELECT q0 AS cohort_idx, plan AS plan_name, band AS employee_range, r AS relative_quarter, firms AS companies_in_quarter,
            live AS active_companies_in_quarter, {dbl("rev")} AS revenue_in_quarter FROM c""",
    ),
)
def _retention(t):
    members = K.cohort_first(t.sales, t.companies, t.subscriptions, t.plans)
    delivered = K.delivered_quarters(G.deliveries(t.versions), t.sales, t.sale_items, "item")
    return K.cohort_retention(members, t.sales, delivered, AS_OF).select(
        *K.CELL, "relative_quarter", "companies_in_quarter", "active_companies_in_quarter", "revenue_in_quarter"
    )


@register_roles(
    "d_stock_turnover",
    over(
        "customer_products customer_product_sizes companies shipping_orders shipments shipment_items",
        f"""WITH stock AS (
            SELECT cp.company_id, sum(CASE WHEN z.id IS NULL THEN coalesce(cp.unique_inventory_amount, 0) ELSE coalesce(z.inventory_amount, 0) END) AS n
            FROM customer_products cp LEFT JOIN customer_product_sizes z ON z.customer_product_id = cp.id
            WHERE cp.company_id IS NOT NULL AND (cp.unique_inventory_amount > 0 OR z.inventory_amount > 0) GROUP BY 1),
        used AS (
            SELECT o.company_id, sum(i.quantity) AS q, count(DISTINCT date_trunc('month', o.created_at)) AS k
            FROM shipping_orders o JOIN shipments s ON s.shipping_order_id = o.id JOIN shipment_items i ON i.shipment_id = s.id
            WHERE o.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH AND o.status <> 'canceled' AND s.deleted_at IS NULL AND o.deleted_at IS NULL
              AND s.shipment_category IN ('SHIPPING', 'DEVOLUTION_RESEND') GROUP BY 1)
        SELECT stock.company_id, cast(n AS bigint) AS stock, cast(q AS bigint) AS shipped, k AS active_months, round(q / k, 2) AS monthly_mean,
            round(n / nullif(round(q / k, 2), 0), 1) AS turnover FROM stock LEFT JOIN used ON used.company_id = stock.company_id""",
    ),
)
def _turnover(t):
    use = stock.monthly_consumption(t.shipping_orders, t.shipments, t.shipment_items, AS_OF)
    return stock.stock_turnover(stock.company_stock(t.customer_products, t.customer_product_sizes), use)


@register_roles(
    "d_stock_origin",
    over(
        "customer_products inventory_moves sale_items",
        """SELECT cp.id AS customer_product_id, CASE
            WHEN cp.id IN (SELECT customer_product_id FROM inventory_moves WHERE operation_type IN ('RECEIPT', 'picking'))
             AND cp.id IN (SELECT customer_product_id FROM sale_items WHERE customer_product_id IS NOT NULL) THEN 'bought'
            WHEN cp.id IN (SELECT customer_product_id FROM inventory_moves WHERE operation_type IN ('manual_input', 'customer_input'))
              OR cp.id NOT IN (SELECT customer_product_id FROM sale_items WHERE customer_product_id IS NOT NULL) THEN 'Recebido diretamente do cliente'
            ELSE 'Desconhecido' END AS origin FROM customer_products cp""",
    ),
)
def _origin(t):
    return stock.stock_origin(t.customer_products, t.inventory_moves, t.sale_items, "bought")


@register_roles(
    "d_min_price_grid",
    over(
        "products pricing_ranges product_customization_prices product_customization_types product_customization_types_products",
        f"""WITH f AS (
            SELECT p.id, r.units, min(r.product_cost * r.markup + c.price * c.markup) AS v FROM products p JOIN pricing_ranges r ON r.product_id = p.id
            JOIN product_customization_types_products b ON b.product_id = p.id
            JOIN product_customization_prices c ON c.product_customization_type_id = b.product_customization_type_id AND c.quantity = r.units GROUP BY 1, 2)
        SELECT id, {dbl("max(CASE units WHEN 50 THEN v END)")} AS price_50, {dbl("max(CASE units WHEN 100 THEN v END)")} AS price_100,
            {dbl("max(CASE units WHEN 1000 THEN v END)")} AS price_1000 FROM f GROUP BY 1""",
    ),
)
def _grid(t):
    custom = pricing.customization_prices(
        t.product_customization_prices, t.product_customization_types, t.product_customization_types_products
    )
    return pricing.price_grid(t.products, t.pricing_ranges, custom, ["id"])


@register_roles(
    "d_process_age",
    over(
        "shipping_orders",
        f"""SELECT CASE WHEN shipment_expected_to < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'Erro'
            WHEN shipment_expected_to <= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'BackLog' ELSE 'Demanda Futura' END AS age, count(*) AS n
        FROM shipping_orders GROUP BY 1""",
    ),
)
def _age(t):
    return t.shipping_orders.groupBy(L.age_bucket("shipment_expected_to", AS_OF).alias("age")).agg(F.count("*").alias("n"))


@register_roles(
    "d_receipt_qty",
    over(
        "inventory_moves",
        """WITH c AS (SELECT parent_id, sum(expected_quantity) AS n FROM inventory_moves
            WHERE operation_type IN ('RECEIPT', 'customer_input') AND status <> 'CANCELED' GROUP BY 1)
        SELECT m.id, cast(coalesce(c.n, m.quantity, m.expected_quantity) AS bigint) AS received FROM inventory_moves m LEFT JOIN c ON c.parent_id = m.id""",
    ),
)
def _received(t):
    return stock.receipt_qty(t.inventory_moves, t.inventory_moves).select("id", "received")


@register_roles(
    "d_order_measure_fallback",
    over(
        "shipping_orders shipments shipment_items shipping_order_items customer_products",
        f"""WITH a AS (
            SELECT s.shipping_order_id AS oid, sum(i.quantity) AS q, sum(coalesce(p.unit_price, 0) * i.quantity) AS v, count(DISTINCT p.sku) AS k
            FROM shipment_items i JOIN shipments s ON s.id = i.shipment_id LEFT JOIN customer_products p ON p.id = i.customer_product_id
            WHERE s.deleted_at IS NULL GROUP BY 1),
        b AS (
            SELECT i.shipping_order_id AS oid, sum(i.quantity * coalesce(o.total_kits_quantity, 1)) AS q,
                sum(coalesce(p.unit_price, 0) * i.quantity * coalesce(o.total_kits_quantity, 1)) AS v, count(DISTINCT p.sku) AS k
            FROM shipping_order_items i LEFT JOIN shipping_orders o ON o.id = i.shipping_order_id
            LEFT JOIN customer_products p ON p.id = i.customer_product_id GROUP BY 1)
        SELECT o.id, cast(coalesce(a.q, b.q, 0) AS bigint) AS total_quantity, {dbl("coalesce(a.v, b.v, 0)")} AS total_value,
            coalesce(a.k, b.k, 0) AS total_skus FROM shipping_orders o LEFT JOIN a ON a.oid = o.id LEFT JOIN b ON b.oid = o.id""",
    ),
)
def _measures(t):
    return stock.measure_fallback(
        t.shipping_orders.select("id"),
        stock.shipment_measures(t.shipments, t.shipment_items, t.customer_products),
        stock.order_measures(t.shipping_orders, t.shipping_order_items, t.customer_products),
    )


@register_roles(
    "d_kit_share",
    over(
        "shipments shipment_items shipping_orders",
        """WITH g AS (SELECT s.shipping_order_id AS oid, s.id, sum(i.quantity) AS pieces FROM shipments s JOIN shipment_items i ON i.shipment_id = s.id GROUP BY 1, 2)
        SELECT g.oid AS shipping_order_id, g.id, cast(pieces AS bigint) AS pieces,
            round(cast(o.total_kits_quantity AS double) * pieces / nullif(sum(pieces) OVER (PARTITION BY g.oid), 0), 4) AS share
        FROM g JOIN shipping_orders o ON o.id = g.oid""",
    ),
)
def _share(t):
    pieces = t.shipment_items.groupBy(F.col("shipment_id").alias("id")).agg(F.sum("quantity").alias("pieces"))
    kits = pick(t.shipping_orders, id="shipping_order_id", total_kits_quantity="kits")
    rows = t.shipments.select("id", "shipping_order_id").join(pieces, "id").join(kits, "shipping_order_id")
    shared = orders.share_of_total(rows, ["shipping_order_id"], "pieces", "kits", "share", 4)
    return shared.select("shipping_order_id", "id", "pieces", "share")


@register_roles(
    "d_week_label",
    over(
        "suppliers",
        """SELECT id, 'Semana ' || strftime(date_trunc('week', created_at), '%V') || ' - ' || strftime(date_trunc('week', created_at), '%d/%m/%Y') AS label
        FROM suppliers""",
    ),
)
def _week(t):
    return t.suppliers.select("id", week_label("created_at").alias("label"))


@register_roles(
    "d_delivery_reason",
    over(
        "shipments",
        f"""WITH e AS (SELECT id, unnest(cast(tracking_events AS json[]))->>'description' AS d FROM shipments),
        r AS (SELECT id, {agg_text("d")} AS reason FROM e WHERE d ILIKE '%Objeto não entregue%' GROUP BY 1)
        SELECT s.id, r.reason FROM shipments s LEFT JOIN r ON r.id = s.id""",
    ),
)
def _reason(t):
    return t.shipments.select("id", matching_descriptions("tracking_events", "%Objeto não entregue%").alias("reason"))


@register_roles(
    "d_price_modifier",
    over(
        "sale_items",
        f"""SELECT id, CASE price_modifier_type WHEN 'PERCENTAGE' THEN {dbl("price_modifier_value")} / 100
            WHEN 'VALUE' THEN {dbl("price_modifier_value")} ELSE 0.0 END AS discount FROM sale_items""",
    ),
)
def _modifier(t):
    return t.sale_items.select("id", L.price_modifier("price_modifier_type", "price_modifier_value").alias("discount"))


@register_roles(
    "d_status_date",
    over("sale_status_edits", "SELECT sale_id, max(created_at) AS entered_at FROM sale_status_edits WHERE new_status = 'TO_PRODUCE' GROUP BY 1"),
)
def _status_date(t):
    return orders.status_date(t.sale_status_edits)


@register_roles(
    "d_shipping_type",
    over(
        "shipments shipment_items shipping_orders",
        f"""WITH n AS (SELECT s.id, s.shipping_order_id, count(DISTINCT i.customer_product_id) AS k FROM shipments s LEFT JOIN shipment_items i ON i.shipment_id = s.id GROUP BY 1, 2)
        SELECT n.id, k AS sku_count, CASE WHEN k = 0 THEN 'Admin - Envio Sem SKU' ELSE {label_sql("o.created_through", L.CREATED_THROUGH, "Indefinido")} END AS kind
        FROM n JOIN shipping_orders o ON o.id = n.shipping_order_id""",
    ),
)
def _type(t):
    skus = t.shipment_items.groupBy(F.col("shipment_id").alias("id")).agg(F.count_distinct("customer_product_id").alias("sku_count"))
    via = pick(t.shipping_orders, id="shipping_order_id", created_through="created_through")
    rows = t.shipments.select("id", "shipping_order_id").join(skus, "id", "left").join(via, "shipping_order_id")
    rows = rows.withColumn("sku_count", F.coalesce("sku_count", F.lit(0)))
    return rows.select("id", "sku_count", L.shipping_type("sku_count", "created_through").alias("kind"))


@register_roles(
    "d_customer_revenue",
    over(
        "sales",
        f"""WITH y AS (SELECT company_id, sum(total_price) AS v FROM sales WHERE year(order_date) = 2024 GROUP BY 1),
        z AS (SELECT company_id, sum(total_price) AS v FROM sales WHERE year(order_date) = 2025 GROUP BY 1),
        t AS (SELECT company_id, sum(total_price) AS v, count(id) AS n FROM sales GROUP BY 1)
        SELECT t.company_id, {dbl("y.v")} AS revenue_2024, {dbl("z.v")} AS revenue_2025, {dbl("t.v")} AS revenue_total, t.n AS orders,
            {dbl("t.v")} / t.n AS mean_ticket FROM t LEFT JOIN y ON y.company_id = t.company_id LEFT JOIN z ON z.company_id = t.company_id""",
    ),
)
def _revenue(t):
    return orders.customer_revenue(t.sales, (2024, 2025))


@register_roles(
    "d_lateness",
    over(
        "shipments shipping_orders",
        """SELECT o.id AS shipping_order_id, bool_or(coalesce(s.shipped_at > o.shipment_expected_to, false)) AS late_client,
            bool_or(coalesce(s.shipped_at > o.created_at + INTERVAL 3 DAY AND s.shipped_at > o.shipment_expected_to, false)) AS late_operation
        FROM shipments s JOIN shipping_orders o ON o.id = s.shipping_order_id GROUP BY 1""",
    ),
)
def _late(t):
    due = pick(t.shipping_orders, id="shipping_order_id", shipment_expected_to="promised", created_at="created_at")
    rows = t.shipments.select("shipping_order_id", "shipped_at").join(due, "shipping_order_id")
    shipped, promised = F.col("shipped_at"), F.col("promised")
    operation = F.col("created_at") + F.expr("INTERVAL '3' DAY")
    return rows.groupBy("shipping_order_id").agg(
        F.bool_or(orders.late_for_client(shipped, promised)).alias("late_client"),
        F.bool_or(orders.late_for_operation(shipped, promised, operation)).alias("late_operation"),
    )


@register_roles(
    "d_rush_label",
    over(
        "sales",
        """SELECT CASE WHEN is_event AND turbo THEN 'TURBO+EVENTO' WHEN is_event THEN 'EVENTO' WHEN turbo THEN 'TURBO' ELSE 'PADRAO' END AS label,
            count(*) AS n FROM sales GROUP BY 1""",
    ),
)
def _rush(t):
    return t.sales.groupBy(L.rush_label("is_event", "turbo").alias("label")).agg(F.count("*").alias("n"))


@register_roles(
    "d_last_delivery",
    over(
        "sales sale_items inventory_moves",
        """SELECT s.id AS sale_id, s.code, max(m.arrived_at) AS last_delivery_at FROM sales s JOIN sale_items i ON i.sale_id = s.id
        LEFT JOIN inventory_moves m ON m.sale_item_id = i.id
        WHERE s.created_at >= TIMESTAMP '2024-01-01' AND s.status <> 'CANCELED' AND i.status <> 'CANCELED' GROUP BY 1, 2""",
    ),
)
def _delivery(t):
    return orders.last_delivery(t.sales, t.sale_items, t.inventory_moves)
