"""Registered relational primitives, over the star-schema tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bizlake.catalog.registry import agg_text, loc, read, register
from bizlake.catalog.reports_shipping import HOURS_DAYS
from bizlake.functions import labels as L
from bizlake.functions import time as TM
from bizlake.functions.changes import change_pair, has_key
from bizlake.functions.text import concat_skip_null, decimal_comma, first_part, matching_descriptions, string_agg_distinct
from bizlake.operators import keys
from bizlake.operators.calendar import HOURS_HOLIDAYS, business_calendar, business_days_between
from bizlake.operators.ordered import neighbours, next_match, running_sum
from bizlake.operators.orders import share_of_total
from bizlake.operators.ranges import range_count, range_join
from bizlake.plans.common import down, pick, up

MONEY = "decimal(18,2)"
NO_DAYS: tuple = ()


def q(key: str, sql: str, *tables: str):
    """Register a function of the named star tables."""

    def add(build):
        register(key, sql)(lambda spark, sf_dir: build(*[read(spark, sf_dir, name) for name in tables]))
        return build

    return add


def money(c: str):
    return F.col(c).cast(MONEY)


# --- scans -----------------------------------------------------------------------------------


@q("q_scan_project", 'SELECT c_custkey AS id, c_name AS "Nome", c_mktsegment AS "Posição" FROM customer', "customer")
def _(customer):
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("Nome"), F.col("c_mktsegment").alias("Posição"))


@q("q_log_scan", "SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('error', 'purchase')", "events")
def _(events):
    return events.where(F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", "ts", "event_type")


@q(
    "q_unnest_holidays",
    f"""SELECT cast(h AS varchar) AS holiday, count(o_orderkey) AS orders FROM (SELECT unnest([{HOURS_DAYS}]) AS h) x
    LEFT JOIN orders ON strftime(o_orderdate, '%m-%d') = strftime(h, '%m-%d') GROUP BY h""",
    "orders",
)
def _(orders):
    days = F.explode(F.array(*[F.lit(h) for h in HOURS_HOLIDAYS]))
    holidays = orders.sparkSession.range(1).select(days.alias("holiday")).withColumn("md", F.date_format("holiday", "MM-dd"))
    counts = orders.groupBy(F.date_format("o_orderdate", "MM-dd").alias("md")).agg(F.count("*").alias("n"))
    return holidays.join(counts, "md", "left").select("holiday", F.coalesce("n", F.lit(0)).alias("orders"))


@q(
    "q_date_series",
    """WITH b AS (SELECT min(cast(ts AS date)) AS a, max(cast(ts AS date)) AS z FROM events),
    s AS (SELECT cast(unnest(generate_series(a::timestamp, z::timestamp, INTERVAL 1 DAY)) AS date) AS d FROM b)
    SELECT cast(d AS varchar) AS day, isodow(d) >= 6 AS weekend, count(event_id) AS events FROM s LEFT JOIN events ON cast(ts AS date) = d GROUP BY d""",
    "events",
)
def _(events):
    span = events.agg(F.min(TM.day("ts")).alias("a"), F.max(TM.day("ts")).alias("z"))
    days = span.select(F.explode(F.sequence("a", "z", F.expr("INTERVAL '1' DAY"))).alias("day"))
    counts = events.groupBy(TM.day("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", (F.weekday("day") >= 5).alias("weekend"), F.coalesce("n", F.lit(0)).alias("events"))


@q(
    "q_int_series",
    """SELECT cast(k AS int) AS k, count(p_partkey) AS parts FROM range(1, 13) r(k) LEFT JOIN part ON p_size % 12 + 1 = k GROUP BY k""",
    "part",
)
def _(part):
    series = part.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("k"))
    counts = part.groupBy((F.col("p_size") % 12 + 1).alias("k")).agg(F.count("*").alias("n"))
    return series.join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("parts"))


# --- projections and filters -----------------------------------------------------------------


@q("q_star_extend", "SELECT *, p_size + 1 AS next_size, upper(p_type) AS kind FROM part", "part")
def _(part):
    return part.withColumns({"next_size": F.col("p_size") + 1, "kind": F.upper("p_type")})


@q(
    "q_line_value",
    f"""SELECT l_orderkey, l_linenumber, cast(cast(l_extendedprice AS {MONEY}) * cast(l_quantity AS int) AS double) AS value,
        cast(cast(l_extendedprice AS {MONEY}) + cast(l_tax AS {MONEY}) AS double) AS cost FROM lineitem""",
    "lineitem",
)
def _(lineitem):
    return lineitem.select(
        "l_orderkey", "l_linenumber", (money("l_extendedprice") * F.col("l_quantity").cast("int")).alias("value"),
        (money("l_extendedprice") + money("l_tax")).alias("cost"),
    )


@q("q_filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 400000 AND o_orderdate < TIMESTAMP '1999-01-01'", "orders")
def _(orders):
    return orders.where(
        (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") >= 400000) & (F.col("o_orderdate") < TM.ts_lit("1999-01-01"))
    ).select("o_orderkey", "o_totalprice")


@q(
    "q_filter_between",
    "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND o_totalprice BETWEEN 1000 AND 200000",
    "orders",
)
def _(orders):
    return orders.where(
        F.col("o_orderdate").between(TM.ts_lit("1997-01-01"), TM.ts_lit("1997-06-30")) & F.col("o_totalprice").between(1000, 200000)
    ).select("o_orderkey")


@q("q_filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')", "orders")
def _(orders):
    return orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey", "o_orderpriority")


@q(
    "q_filter_null",
    """SELECT p_partkey, c_custkey IS NULL AS unowned FROM part LEFT JOIN customer ON c_custkey = p_partkey
    WHERE c_mktsegment IS NULL OR c_name IS NOT NULL""",
    "part", "customer",
)
def _(part, customer):
    rows = part.join(customer, F.col("c_custkey") == F.col("p_partkey"), "left")
    return rows.where(F.col("c_mktsegment").isNull() | F.col("c_name").isNotNull()).select("p_partkey", F.col("c_custkey").isNull().alias("unowned"))


@q(
    "q_filter_distinct_from",
    "SELECT p_partkey FROM part LEFT JOIN customer ON c_custkey = p_partkey WHERE c_mktsegment IS DISTINCT FROM 'FURNITURE'",
    "part", "customer",
)
def _(part, customer):
    rows = part.join(customer, F.col("c_custkey") == F.col("p_partkey"), "left")
    return rows.where(~F.col("c_mktsegment").eqNullSafe(F.lit("FURNITURE"))).select("p_partkey")


@q("q_filter_like", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR p_type ILIKE 'pro%'", "part")
def _(part):
    return part.where(F.lower("p_name").like("%ring%") | F.col("p_type").ilike("pro%")).select("p_partkey", "p_name")


@q(
    "q_filter_bool",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity > 40)
    OR (l_linestatus = 'O' AND NOT (l_discount < 0.09))""",
    "lineitem",
)
def _(lineitem):
    return lineitem.where(
        ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)) | ((F.col("l_linestatus") == "O") & ~(F.col("l_discount") < 0.09))
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@q(
    "q_filter_derived",
    "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1998, 1999) AND cast(strftime(o_orderdate, '%Y%m') AS int) >= 199807",
    "orders",
)
def _(orders):
    # The year list and the month number are one range of the stored column, so files can be skipped.
    span = (F.col("o_orderdate") >= TM.ts_lit("1998-07-01")) & (F.col("o_orderdate") < TM.ts_lit("2000-01-01"))
    return orders.where(span).select("o_orderkey", F.year("o_orderdate").alias("y"))


@q("q_filter_rolling", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 9 DAY", "events")
def _(events):
    return events.where(F.col("ts") >= TM.as_of_ts("2024-01-31 00:00:00") - F.expr("INTERVAL '9' DAY")).select("event_id")


EVENT_JSON = """'{"status":[' || CASE WHEN value < 50 THEN 'null' ELSE '"old"' END || ',"' || event_type || '"]' ||
    CASE WHEN value > 100 THEN ',"amount":[1,2]' ELSE '' END || '}'"""


def event_json():
    return F.concat(
        F.lit('{"status":['), F.when(F.col("value") < 50, "null").otherwise('"old"'), F.lit(',"'), F.col("event_type"), F.lit('"]'),
        F.when(F.col("value") > 100, ',"amount":[1,2]').otherwise(""), F.lit("}"),
    )


@q(
    "q_json_filter",
    f"""WITH j AS (SELECT event_id, {EVENT_JSON} AS j FROM events)
    SELECT event_id, list_contains(json_keys(j), 'amount') AS has_amount FROM j
    WHERE (j::json->'status'->>1) = 'error' OR ((j::json->'status'->>0) IS NOT NULL AND list_contains(json_keys(j), 'amount'))""",
    "events",
)
def _(events):
    rows = events.select("event_id", event_json().alias("j"))
    pair = change_pair("j", "status")
    hit = (F.get(pair, F.lit(1)) == "error") | (F.get(pair, F.lit(0)).isNotNull() & has_key("j", "amount"))
    return rows.where(hit).select("event_id", has_key("j", "amount").alias("has_amount"))


# --- joins -----------------------------------------------------------------------------------


@q("q_join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey", "orders", "customer")
def _(orders, customer):
    return orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@q("q_join_left", "SELECT p_partkey, c_name FROM part LEFT JOIN customer ON c_custkey = p_partkey", "part", "customer")
def _(part, customer):
    return part.join(customer, F.col("c_custkey") == F.col("p_partkey"), "left").select("p_partkey", "c_name")


@q(
    "q_join_multikey",
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, n FROM lineitem l JOIN g ON g.l_orderkey = l.l_orderkey AND g.l_linenumber = l.l_linenumber""",
    "lineitem",
)
def _(lineitem):
    g = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return lineitem.join(g, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "n")


@q(
    "q_join_role_dims",
    """SELECT p_partkey, a.s_name AS supplier, b.s_name AS customizer FROM part LEFT JOIN supplier a ON a.s_suppkey = p_size
    LEFT JOIN supplier b ON b.s_suppkey = p_size + 60""",
    "part", "supplier",
)
def _(part, supplier):
    rows = part.withColumns({"a": F.col("p_size").cast("bigint"), "b": (F.col("p_size") + 60).cast("bigint")})
    return rows.join(pick(supplier, s_suppkey="a", s_name="supplier"), "a", "left").join(
        pick(supplier, s_suppkey="b", s_name="customizer"), "b", "left"
    ).select("p_partkey", "supplier", "customizer")


@q(
    "q_join_cast",
    "SELECT event_id, c_name FROM (SELECT event_id, cast(user_id AS varchar) AS u FROM events) e JOIN customer ON cast(c_custkey AS varchar) = e.u",
    "events", "customer",
)
def _(events, customer):
    log = events.select("event_id", F.col("user_id").cast("string").alias("u"))
    return log.join(customer, F.col("u") == F.col("c_custkey").cast("string")).select("event_id", "c_name")


@q(
    "q_join_cond",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "orders", "customer",
)
def _(orders, customer):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F")
    return orders.join(customer, on, "left").select("o_orderkey", "c_name")


@q(
    "q_join_expr",
    """SELECT p_partkey, n_name FROM part LEFT JOIN customer ON c_custkey = p_partkey LEFT JOIN nation ON n_nationkey = coalesce(c_nationkey, p_size)""",
    "part", "customer", "nation",
)
def _(part, customer, nation):
    rows = part.join(customer, F.col("c_custkey") == F.col("p_partkey"), "left")
    return rows.join(nation, F.col("n_nationkey") == F.coalesce("c_nationkey", "p_size"), "left").select("p_partkey", "n_name")


@q(
    "q_join_range",
    """WITH w AS (SELECT cast(d AS date) AS d FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6),
    span AS (SELECT DISTINCT cast(o_orderdate AS date) AS a, cast(l_shipdate AS date) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    n AS (SELECT a, b, count(w.d) AS n FROM span LEFT JOIN w ON w.d BETWEEN a AND b GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, cast(n AS int) AS work_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN n ON a = cast(o_orderdate AS date) AND b = cast(l_shipdate AS date)""",
    "lineitem", "orders",
)
def _(lineitem, orders):
    rows = lineitem.join(orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = business_days_between("o_orderdate", "l_shipdate", NO_DAYS, date(1995, 1, 1), date(2001, 12, 31))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", days.alias("work_days"))


@q(
    "q_range_join",
    "SELECT c_custkey, s_suppkey, c_acctbal, s_acctbal FROM customer JOIN supplier ON s_acctbal BETWEEN c_acctbal AND c_acctbal + 100",
    "customer", "supplier",
)
def _(customer, supplier):
    bands = customer.select("c_custkey", "c_acctbal", (F.col("c_acctbal") + 100).alias("up_to"))
    return range_join(supplier.select("s_suppkey", "s_acctbal"), bands, "s_acctbal", "c_acctbal", "up_to", 100).drop("up_to")


@q(
    "q_range_count",
    """WITH span AS (SELECT DISTINCT cast(o_orderdate AS date) AS a, cast(l_shipdate AS date) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    d AS (SELECT cast(o_orderdate AS date) AS d, count(*) AS n FROM orders GROUP BY 1),
    n AS (SELECT a, b, coalesce(sum(d.n), 0) AS n FROM span LEFT JOIN d ON d BETWEEN a AND b GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, cast(n AS bigint) AS orders_meanwhile FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN n ON a = cast(o_orderdate AS date) AND b = cast(l_shipdate AS date)""",
    "lineitem", "orders",
)
def _(lineitem, orders):
    placed = orders.select("o_orderkey", TM.day("o_orderdate").alias("ordered"))
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", TM.day("l_shipdate").alias("shipped"))
    rows = rows.join(placed, F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey")
    counted = range_count(rows, placed.select(F.col("ordered").alias("day")), "day", "ordered", "shipped", 30, "orders_meanwhile")
    return counted.select("l_orderkey", "l_linenumber", "l_partkey", "orders_meanwhile")


@q(
    "q_join_cross",
    "SELECT c_custkey, cast(k AS int) AS relative_quarter FROM customer, range(1, 13) r(k)",
    "customer",
)
def _(customer):
    # Every row with a fixed short series: an explode, not a join.
    return customer.select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("relative_quarter"))


TRACK_SQL = """'[{"description":"' || p_name || '"},{"description":"' || upper(p_type) || '"},{"description":null}]'"""


def track_json():
    return F.concat(F.lit('[{"description":"'), F.col("p_name"), F.lit('"},{"description":"'), F.upper("p_type"), F.lit('"},{"description":null}]'))


@q(
    "q_lateral_json",
    f"""WITH t AS (SELECT p_partkey, unnest(cast({TRACK_SQL} AS json[]))->>'description' AS d FROM part)
    SELECT p.p_partkey, m.d FROM part p LEFT JOIN (SELECT p_partkey, {agg_text("d")} AS d FROM t WHERE d ILIKE '%a%' GROUP BY 1) m ON m.p_partkey = p.p_partkey""",
    "part",
)
def _(part):
    return part.select("p_partkey", matching_descriptions(track_json(), "%a%").alias("d"))


@q(
    "q_exists_flags",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final,
        NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS no_urgent FROM customer""",
    "customer", "orders",
)
def _(customer, orders):
    flags = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u")
    )
    no = F.lit(False)
    return customer.join(flags, "c_custkey", "left").select("c_custkey", F.coalesce("f", no).alias("has_final"), (~F.coalesce("u", no)).alias("no_urgent"))


@q(
    "q_semi_in",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "orders", "lineitem",
)
def _(orders, lineitem):
    wanted = lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.select("o_orderkey").join(wanted, "o_orderkey", "left_semi")


@q(
    "q_anti_holidays",
    f"""SELECT event_id FROM events WHERE isodow(ts) < 6 AND cast(ts AS date) NOT IN (SELECT unnest([{HOURS_DAYS}]))""",
    "events",
)
def _(events):
    holidays = events.sparkSession.range(1).select(F.explode(F.array(*[F.lit(h) for h in HOURS_HOLIDAYS])).alias("day"))
    rows = events.where(F.weekday("ts") < 5).select("event_id", TM.day("ts").alias("day"))
    # A fixed list of a few days, so the broadcast is bounded.
    return rows.join(F.broadcast(holidays), "day", "left_anti").select("event_id")


@q(
    "q_join_derived",
    f"""SELECT c_custkey, n, cast(v AS double) AS v FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(cast(o_totalprice AS {MONEY})) AS v
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) d ON d.o_custkey = c_custkey""",
    "customer", "orders",
)
def _(customer, orders):
    d = orders.where(F.col("o_orderstatus") != "P").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("v")
    )
    return customer.select("c_custkey").join(d, "c_custkey", "left")


@q(
    "q_join_bridge",
    """SELECT l_orderkey, p_name, s_name FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) b
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    "lineitem", "part", "supplier",
)
def _(lineitem, part, supplier):
    bridge = lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return bridge.join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        "l_orderkey", "p_name", "s_name"
    )


@q(
    "q_preagg_join",
    """SELECT o_orderkey, o_custkey, cast(pieces AS bigint) AS pieces, parts FROM orders LEFT JOIN
    (SELECT l_orderkey, sum(cast(l_quantity AS int)) AS pieces, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) g ON l_orderkey = o_orderkey""",
    "orders", "lineitem",
)
def _(orders, lineitem):
    g = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_quantity").cast("int")).alias("pieces"), F.count_distinct("l_partkey").alias("parts")
    )
    return orders.select("o_orderkey", "o_custkey").join(g, "o_orderkey", "left")


# --- aggregations ----------------------------------------------------------------------------


@q(
    "q_agg_basic",
    f"""SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity AS int)) AS bigint) AS sum_qty, cast(sum(cast(l_extendedprice AS {MONEY})) AS double) AS sum_price,
        round(avg(l_quantity), 6) AS avg_qty, count(*) AS n, count(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2""",
    "lineitem",
)
def _(lineitem):
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("int")).alias("sum_qty"), F.sum(money("l_extendedprice")).alias("sum_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"), F.count("l_shipdate").alias("shipped"),
    )


@q(
    "q_agg_minmax",
    """SELECT o_custkey, min(o_totalprice) AS lo, max(o_orderdate) AS last_at, min(o_orderpriority) AS first_text, cast(max(cast(o_orderdate AS date)) AS varchar) AS last_on
    FROM orders GROUP BY 1""",
    "orders",
)
def _(orders):
    return orders.groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_orderdate").alias("last_at"), F.min("o_orderpriority").alias("first_text"),
        F.max(TM.day("o_orderdate")).alias("last_on"),
    )


@q(
    "q_agg_count_distinct",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders,
        count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned, count(DISTINCT date_trunc('month', l_shipdate)) AS months FROM lineitem GROUP BY 1""",
    "lineitem",
)
def _(lineitem):
    return lineitem.groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"),
        F.count_distinct(TM.month_start("l_shipdate")).alias("months"),
    )


@q(
    "q_agg_sum_distinct",
    f"SELECT o_custkey, cast(sum(DISTINCT cast(round(o_totalprice, -4) AS {MONEY})) AS double) AS v FROM orders GROUP BY 1",
    "orders",
)
def _(orders):
    return orders.groupBy("o_custkey").agg(F.sum_distinct(F.round("o_totalprice", -4).cast(MONEY)).alias("v"))


@q(
    "q_agg_string",
    f"""SELECT l_suppkey, {agg_text("l_returnflag || '-' || l_linenumber")} AS kinds, {agg_text("CASE WHEN l_quantity > 49 THEN l_partkey END")} AS big_parts
    FROM lineitem GROUP BY 1""",
    "lineitem",
)
def _(lineitem):
    kinds = F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string"))
    return lineitem.groupBy("l_suppkey").agg(
        string_agg_distinct(kinds).alias("kinds"), string_agg_distinct("l_partkey", F.col("l_quantity") > 49).alias("big_parts")
    )


@q(
    "q_agg_filter",
    f"""SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) FILTER (value > 50) AS kinds,
        min(ts) FILTER (event_type = 'purchase') AS first_buy, max(ts) FILTER (event_type = 'purchase') AS last_buy,
        string_agg(DISTINCT event_type, ', ' ORDER BY event_type) FILTER (value > 200) AS high FROM events GROUP BY 1""",
    "events",
)
def _(events):
    kind, bought = F.col("event_type"), F.col("event_type") == "purchase"
    return events.groupBy("user_id").agg(
        F.count_if(kind == "error").alias("errors"), F.count_distinct(F.when(F.col("value") > 50, kind)).alias("kinds"),
        F.min(F.when(bought, F.col("ts"))).alias("first_buy"), F.max(F.when(bought, F.col("ts"))).alias("last_buy"),
        string_agg_distinct(kind, F.col("value") > 200).alias("high"),
    )


@q("q_agg_bool_or", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_p, bool_or(o_totalprice > 490000) AS any_big FROM orders GROUP BY 1", "orders")
def _(orders):
    return orders.groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"), F.bool_or(F.col("o_totalprice") > 490000).alias("any_big")
    )


@q(
    "q_agg_case",
    """SELECT l_partkey, cast(sum(CASE WHEN l_returnflag <> 'N' THEN cast(l_quantity AS int) ELSE 0 END) AS bigint) AS handled,
        count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_suppkey END) AS suppliers, max(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS max_tax FROM lineitem GROUP BY 1""",
    "lineitem",
)
def _(lineitem):
    return lineitem.groupBy("l_partkey").agg(
        F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int")).otherwise(0)).alias("handled"),
        F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("suppliers"),
        F.max(F.when(F.col("l_linestatus") == "O", F.col("l_tax"))).alias("max_tax"),
    )


@q(
    "q_pivot",
    """SELECT l_partkey, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS price_a, max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS price_n,
        max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS price_r FROM lineitem GROUP BY 1""",
    "lineitem",
)
def _(lineitem):
    wide = lineitem.groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_extendedprice"))
    return wide.withColumnsRenamed({"A": "price_a", "N": "price_n", "R": "price_r"})


@q(
    "q_having",
    "SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') > 2",
    "orders",
)
def _(orders):
    n = F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return orders.groupBy("o_custkey").agg(n.alias("n")).where(F.col("n") > 2)


@q(
    "q_group_expr",
    "SELECT strftime(o_orderdate, '%Y-%m') AS ym, cast(floor(o_totalprice / 100000) AS int) AS band, count(*) AS n FROM orders GROUP BY 1, 2",
    "orders",
)
def _(orders):
    return orders.groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("band")
    ).agg(F.count("*").alias("n"))


@q("q_group_distinct", "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey", "lineitem")
def _(lineitem):
    return lineitem.select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


@q(
    "q_agg_two_stage",
    """WITH a AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT l_partkey, max(v) AS v, count(*) AS n FROM a GROUP BY 1""",
    "lineitem",
)
def _(lineitem):
    first = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("v"))
    return first.groupBy("l_partkey").agg(F.max("v").alias("v"), F.count("*").alias("n"))


@q("q_scalar_max", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01')", "orders")
def _(orders):
    top = orders.where(F.col("o_orderdate") <= TM.ts_lit("2000-06-01")).agg(F.max("o_orderdate").alias("o_orderdate"))
    # One row by construction.
    return orders.join(F.broadcast(top), "o_orderdate", "left_semi").select("o_orderkey")


# --- ordering along a key --------------------------------------------------------------------


@q(
    "q_win_row_number",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE rn = 1""",
    "orders",
)
def _(orders):
    return keys.first_per_key(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@q(
    "q_win_sequence",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS rn FROM events",
    "events",
)
def _(events):
    rows = events.select("user_id", "event_id", "ts", "event_type")
    return neighbours(rows, ["user_id"], ["ts", "event_type", "event_id"], sequence="rn").select("user_id", "event_id", "rn")


@q(
    "q_win_priority",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size = 10 THEN 1 ELSE 2 END, p_size, p_partkey) AS rn FROM part)
    SELECT p_brand, p_partkey, p_size FROM r WHERE rn = 1""",
    "part",
)
def _(part):
    return keys.first_per_key(part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_size") != 10, "p_size", "p_partkey"])


@q(
    "q_calendar_index",
    """WITH w AS (SELECT cast(d AS date) AS d, row_number() OVER (ORDER BY d) AS rn FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) r(d)
        WHERE isodow(d) < 6)
    SELECT cast(d AS varchar) AS day, cast(rn AS int) AS rn, count(o_orderkey) AS orders FROM w LEFT JOIN orders ON cast(o_orderdate AS date) = d GROUP BY d, rn""",
    "orders",
)
def _(orders):
    days = business_calendar(orders.sparkSession, date(1995, 1, 1), date(2001, 12, 31), NO_DAYS).where("is_bd")
    counts = orders.groupBy(TM.day("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.col("bd_idx").alias("rn"), F.coalesce("n", F.lit(0)).alias("orders"))


@q(
    "q_win_latest_only",
    """SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN o_totalprice END AS shown
    FROM orders""",
    "orders",
)
def _(orders):
    newest = keys.last_per_key(orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    # The newest order key identifies the row, so a hot customer's rows spread by order.
    flags = newest.select("o_orderkey").withColumn("_top", F.lit(True))
    return orders.join(flags, "o_orderkey", "left").select("o_custkey", "o_orderkey", F.when(F.col("_top"), F.col("o_totalprice")).alias("shown"))


@q(
    "q_win_lag",
    "SELECT event_id, lag(event_type) OVER w AS before, lead(ts) OVER w AS next_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "events",
)
def _(events):
    rows = events.select("event_id", "user_id", "ts", "event_type")
    return neighbours(rows, ["user_id"], ["ts", "event_id"], previous={"event_type": "before"}, following={"ts": "next_at"}).select(
        "event_id", "before", "next_at"
    )


@q("q_win_count", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", "orders")
def _(orders):
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return orders.select("o_orderkey", "o_custkey").join(counts, "o_custkey")


@q(
    "q_win_running_sum",
    f"""SELECT o_orderkey, o_custkey, cast(sum(cast(o_totalprice AS {MONEY})) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS double) AS total FROM orders""",
    "orders",
)
def _(orders):
    rows = orders.select("o_orderkey", "o_custkey", "o_orderdate", money("o_totalprice").alias("price"))
    return running_sum(rows, ["o_custkey"], "o_orderdate", "price", "total").select("o_orderkey", "o_custkey", "total")


@q(
    "q_win_share",
    """WITH g AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_suppkey, n, round(100.0 * n / nullif(sum(n) OVER (PARTITION BY l_orderkey), 0), 4) AS share FROM g""",
    "lineitem",
)
def _(lineitem):
    g = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("n")).withColumn("hundred", F.lit(100.0))
    return share_of_total(g, ["l_orderkey"], "n", "hundred", "share", 4).drop("hundred")


@q("q_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC", "orders")
def _(orders):
    rows = orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return keys.last_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# --- sorts, sets, subqueries -----------------------------------------------------------------


@q("q_sort", "SELECT c_name, c_acctbal AS balance FROM customer ORDER BY balance DESC, c_name", "customer")
def _(customer):
    return customer.select("c_name", F.col("c_acctbal").alias("balance")).orderBy(down("balance"), *up("c_name"))


@q(
    "q_sort_case",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey",
    "orders",
)
def _(orders):
    return orders.orderBy(L.priority("o_orderstatus", ["P", "O"]), "o_orderkey").select("o_orderkey", "o_orderstatus")


@q("q_sort_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY max(o_orderdate) DESC, o_custkey", "orders")
def _(orders):
    g = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return g.orderBy(down("last"), *up("o_custkey")).select("o_custkey", "n")


@q(
    "q_top1",
    """SELECT e.event_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts > e.ts) AS next_buy FROM events e""",
    "events",
)
def _(events):
    rows = events.select("event_id", "user_id", "ts", "event_type")
    return next_match(rows, ["user_id"], "ts", F.col("event_type") == "purchase", "next_buy").select("event_id", "next_buy")


@q(
    "q_union_all",
    """SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part""",
    "customer", "supplier", "part",
)
def _(customer, supplier, part):
    def branch(df, kind, c):
        return df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))

    return branch(customer, "customer", "c_name").unionByName(branch(supplier, "supplier", "s_name")).unionByName(branch(part, "part", "p_name"))


@q("q_distinct", "SELECT DISTINCT p_name, p_type FROM part", "part")
def _(part):
    return part.select("p_name", "p_type").distinct()


@q(
    "q_scalar_subquery",
    f"""SELECT c_custkey, (SELECT {agg_text("o_orderpriority")} FROM orders WHERE o_custkey = c_custkey) AS priorities FROM customer""",
    "customer", "orders",
)
def _(customer, orders):
    g = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(string_agg_distinct("o_orderpriority").alias("priorities"))
    return customer.select("c_custkey").join(g, "c_custkey", "left")


@q(
    "q_scalar_or",
    """WITH v AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size % 7 + 1 END AS variant FROM part)
    SELECT p_partkey, variant, cast(coalesce((SELECT sum(cast(l_quantity AS int)) FROM lineitem WHERE l_partkey = p_partkey
        AND (variant IS NULL OR l_linenumber = variant)), 0) AS bigint) AS moved FROM v""",
    "part", "lineitem",
)
def _(part, lineitem):
    quantity = F.sum(F.col("l_quantity").cast("int"))
    by_part = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(quantity.alias("all_moved"))
    by_both = lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("variant")).agg(quantity.alias("some_moved"))
    rows = part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size") % 7 + 1).alias("variant"))
    rows = rows.join(by_part, "p_partkey", "left").join(by_both, ["p_partkey", "variant"], "left")
    moved = F.when(F.col("variant").isNull(), F.col("all_moved")).otherwise(F.col("some_moved"))
    return rows.select("p_partkey", "variant", F.coalesce(moved, F.lit(0)).alias("moved"))


# --- scalar functions ------------------------------------------------------------------------


@q(
    "q_str_concat",
    """SELECT p_partkey, concat(c_name, ' ', p_name) AS skipping, c_name || ' ' || p_name AS strict, '''' || p_brand AS quoted
    FROM part LEFT JOIN customer ON c_custkey = p_partkey""",
    "part", "customer",
)
def _(part, customer):
    rows = part.join(customer, F.col("c_custkey") == F.col("p_partkey"), "left")
    return rows.select(
        "p_partkey", concat_skip_null(F.col("c_name"), " ", F.col("p_name")).alias("skipping"),
        F.concat("c_name", F.lit(" "), "p_name").alias("strict"), F.concat(F.lit("'"), "p_brand").alias("quoted"),
    )


@q("q_str_split", "SELECT p_partkey, trim(split_part(' ' || p_brand || ' - ' || p_size, '-', 1)) AS head FROM part", "part")
def _(part):
    code = F.concat(F.lit(" "), "p_brand", F.lit(" - "), F.col("p_size").cast("string"))
    return part.select("p_partkey", first_part(code).alias("head"))


@q("q_str_decimal_comma", f"SELECT p_partkey, replace(cast(cast(p_retailprice AS {MONEY}) AS varchar), '.', ',') AS price FROM part", "part")
def _(part):
    return part.select("p_partkey", decimal_comma(money("p_retailprice")).alias("price"))


FORMATS = {
    "a": ("dd/MM/yyyy", "%d/%m/%Y"), "b": ("dd-MM-yyyy", "%d-%m-%Y"), "c": ("yyyy-MM-dd", "%Y-%m-%d"), "d": ("yyyy-MM", "%Y-%m"),
    "e": ("MM/yyyy", "%m/%Y"), "f": ("yyyyMM", "%Y%m"), "g": ("MM", "%m"), "h": ("yyyy", "%Y"),
}


@q("q_date_format", "SELECT event_id, " + ", ".join(f"strftime(ts, '{d}') AS {n}" for n, (_, d) in FORMATS.items()) + " FROM events", "events")
def _(events):
    return events.select("event_id", *[TM.fmt("ts", s).alias(n) for n, (s, _) in FORMATS.items()])


@q("q_week_label", "SELECT o_orderkey, strftime(o_orderdate, '%V') AS iw, 'Semana ' || strftime(date_trunc('week', o_orderdate), '%V - %d/%m/%Y') AS label FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", TM.iso_week_text("o_orderdate").alias("iw"), TM.week_label("o_orderdate").alias("label"))


@q(
    "q_date_extract",
    """SELECT event_id, year(ts) AS y, month(ts) AS m, week(ts) AS w, hour(ts) AS h, dayofweek(ts) AS dow, (dayofweek(ts) + 6) % 7 AS since_monday FROM events""",
    "events",
)
def _(events):
    return events.select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.weekofyear("ts").alias("w"), F.hour("ts").alias("h"),
        TM.dow_sunday0("ts").alias("dow"), F.weekday("ts").alias("since_monday"),
    )


@q(
    "q_elapsed",
    """SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate - o_orderdate) / 3600e6 AS hours, round(epoch_us(l_shipdate - o_orderdate) / 86400e6, 2) AS days
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "lineitem", "orders",
)
def _(lineitem, orders):
    rows = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", TM.elapsed_hours("o_orderdate", "l_shipdate").alias("hours"),
        F.round(TM.elapsed_days("o_orderdate", "l_shipdate"), 2).alias("days"),
    )


@q("q_date_trunc", "SELECT event_id, date_trunc('day', ts) AS d, cast(cast(date_trunc('month', ts) AS date) AS varchar) AS m FROM events", "events")
def _(events):
    return events.select("event_id", TM.day_start("ts").alias("d"), TM.month_start("ts").alias("m"))


@q(
    "q_cutoff",
    """SELECT event_id, cast(ts AS time) >= TIME '18:00:00' AS late, cast(cast(CASE WHEN cast(ts AS time) >= TIME '18:00:00' THEN ts + INTERVAL 1 DAY ELSE ts END AS date) AS varchar) AS counted_on
    FROM events""",
    "events",
)
def _(events):
    late = TM.second_of_day("ts") >= 18 * 3600
    return events.select("event_id", late.alias("late"), F.date_add(TM.day("ts"), F.when(late, 1).otherwise(0)).alias("counted_on"))


@q(
    "q_date_arith",
    """SELECT event_id, ts + INTERVAL 1 DAY AS tomorrow, ts - INTERVAL 6 MONTH AS half_year_ago, cast(cast(ts - (dayofweek(ts) + 6) % 7 * INTERVAL 1 DAY AS date) AS varchar) AS monday,
        date_diff('day', cast(ts AS date), DATE '2024-01-31') AS days_left FROM events""",
    "events",
)
def _(events):
    return events.select(
        "event_id", (F.col("ts") + F.expr("INTERVAL '1' DAY")).alias("tomorrow"), (F.col("ts") - F.expr("INTERVAL '6' MONTH")).alias("half_year_ago"),
        TM.week_start("ts").alias("monday"), F.datediff(F.lit(date(2024, 1, 31)), TM.day("ts")).alias("days_left"),
    )


@q(
    "q_tz_convert",
    f"""SELECT event_id, {loc("ts")} AS local_at, (ts AT TIME ZONE 'America/Sao_Paulo' AT TIME ZONE 'UTC') AS assumed_local FROM events""",
    "events",
)
def _(events):
    return events.select("event_id", TM.local_ts("ts").alias("local_at"), TM.local_ts("ts", mode="assume_local").alias("assumed_local"))


@q("q_quarter_label", "SELECT o_orderkey, year(o_orderdate) || ' Q' || cast(ceil(month(o_orderdate) / 3.0) AS int) AS quarter FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", TM.quarter_label(TM.quarter_index("o_orderdate")).alias("quarter"))


@q(
    "q_math",
    f"""SELECT o_orderkey, cast(round(cast(o_totalprice AS {MONEY}) / 7, 2) AS double) AS r, cast(ceil(o_totalprice / 1000) AS bigint) AS c,
        cast(floor(o_totalprice / 1000) AS bigint) AS f, o_custkey % 7 AS m, greatest(0, o_totalprice - 250000) AS g FROM orders""",
    "orders",
)
def _(orders):
    return orders.select(
        "o_orderkey", F.round(money("o_totalprice") / 7, 2).alias("r"), F.ceil(F.col("o_totalprice") / 1000).alias("c"),
        F.floor(F.col("o_totalprice") / 1000).alias("f"), (F.col("o_custkey") % 7).alias("m"),
        F.greatest(F.lit(0.0), F.col("o_totalprice") - 250000).alias("g"),
    )


@q(
    "q_null_funcs",
    """SELECT p_partkey, nullif(p_size, 7) AS not7, coalesce(c_nationkey, nullif(p_size, 7), -1) AS first_of, c_acctbal / nullif(p_size - 7, 0) AS safe
    FROM part LEFT JOIN customer ON c_custkey = p_partkey""",
    "part", "customer",
)
def _(part, customer):
    rows = part.join(customer, F.col("c_custkey") == F.col("p_partkey"), "left")
    not7 = F.nullif(F.col("p_size"), F.lit(7))
    return rows.select(
        "p_partkey", not7.alias("not7"), F.coalesce("c_nationkey", not7, F.lit(-1)).alias("first_of"),
        (F.col("c_acctbal") / F.nullif(F.col("p_size") - 7, F.lit(0))).alias("safe"),
    )


@q(
    "q_case",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band,
        CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'TURBO' ELSE '' END AS turbo FROM orders""",
    "orders",
)
def _(orders):
    price, urgent = F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT"
    return orders.select(
        "o_orderkey", F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high").alias("band"),
        L.map_labels("o_orderstatus", {"F": "final", "O": "open"}).alias("status"), F.when(urgent, "TURBO").otherwise("").alias("turbo"),
    )


@q(
    "q_cast",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, cast(cast(l_extendedprice AS decimal(10,2)) AS double) AS d, cast(l_quantity AS int) AS i,
        cast(cast(l_orderkey AS varchar) AS bigint) AS b, cast(l_linenumber AS varchar) AS t, cast(l_linenumber AS double) AS f FROM lineitem""",
    "lineitem",
)
def _(lineitem):
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(10,2)").alias("d"), F.col("l_quantity").cast("int").alias("i"),
        F.col("l_orderkey").cast("string").cast("bigint").alias("b"), F.col("l_linenumber").cast("string").alias("t"), F.col("l_linenumber").cast("double").alias("f"),
    )


@q(
    "q_json_extract",
    f"""WITH j AS (SELECT event_id, props, {EVENT_JSON} AS j FROM events)
    SELECT event_id, cast(props::json->>'k' AS int) AS k, j::json->'status'->>0 AS old, j::json->'status'->>1 AS new, j::json->'status'->>-1 AS last,
        j::json->'amount'->>1 AS amount FROM j""",
    "events",
)
def _(events):
    rows = events.select("event_id", "props", event_json().alias("j"))
    pair = change_pair("j", "status")
    return rows.select(
        "event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"), F.get(pair, F.lit(0)).alias("old"), F.get(pair, F.lit(1)).alias("new"),
        F.try_element_at(pair, F.lit(-1)).alias("last"), F.get(change_pair("j", "amount"), F.lit(1)).alias("amount"),
    )
