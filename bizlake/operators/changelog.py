"""Unpacking the append-only change log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.functions.changes import (
    change_pair, has_key, last_of, may_hold, new_of, new_value, old_of, snapshot_value,
)
from bizlake.functions.time import fmt, local_ts, ts_lit
from bizlake.operators.ordered import CUTS, next_instant
from bizlake.sources.schemas import LOG_MONTH


def log_of(log: DataFrame, *item_types: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of some entity types, from one time up to another (exclusive); the filters reach the file scan.

    Of a log stored by type and month (``sources.log_files``) only the folders of those types and months are listed.
    """
    rows = log.where(F.col("item_type").isin(*item_types))
    if since is not None:
        rows = rows.where(F.col("created_at") >= ts_lit(since))
        if LOG_MONTH in log.columns:
            rows = rows.where(F.col(LOG_MONTH) >= str(since)[:7])
    if until is not None:
        rows = rows.where(F.col("created_at") < ts_lit(until))
        if LOG_MONTH in log.columns:
            rows = rows.where(F.col(LOG_MONTH) <= str(until)[:7])
    return rows


def parse_once(df: DataFrame, keep: Sequence[str], **parsed: Column) -> DataFrame:
    """``keep`` plus parsed columns, each computed once per row.

    The optimiser copies a later filter, with the parsing inside it, below a plain
    projection, and the text is then parsed again for every condition. It does not move
    filters below a generator, so the values pass through one.
    """
    packed = F.struct(*[c.alias(name) for name, c in parsed.items()])
    rows = df.select(*keep, F.explode(F.array(packed)).alias("_parsed"))
    return rows.select(*keep, *[F.col(f"_parsed.{name}").alias(name) for name in parsed])


def unpack_changes(
    log: DataFrame, field: str = "status", snapshot_fields: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """One row per log row: old, new and last value of a field, chosen snapshot fields, and columns to keep.

    ``value`` is the new value, or the snapshot's when the change does not hold the
    field. Each JSON text is parsed once.
    """
    wanted = list(dict.fromkeys([field, *snapshot_fields]))
    parsed = parse_once(
        log,
        ["item_id", "created_at", "event", *keep],
        _pair=change_pair("object_changes", field),
        _snapshot=F.from_json("object", f"struct<{', '.join(f'`{f}`:string' for f in wanted)}>"),
    )
    return parsed.select(
        "item_id",
        "created_at",
        "event",
        old_of("_pair").alias("old_value"),
        new_of("_pair").alias("new_value"),
        last_of("_pair").alias("last_value"),
        F.coalesce(new_of("_pair"), F.col(f"_snapshot.{field}")).alias("value"),
        *[F.col(f"_snapshot.{f}").alias(f) for f in snapshot_fields],
        *keep,
    )


def first_transition(
    log: DataFrame, item_type: str, value: str, field: str = "status", event: str | None = "update"
) -> DataFrame:
    """First time each entity took ``value``."""
    rows = log_of(log, item_type)
    if event is not None:
        rows = rows.where(F.col("event") == event)
    return (
        rows.where(may_hold("object_changes", value) & (new_value("object_changes", field) == value))
        .groupBy("item_id")
        .agg(F.min("created_at").alias("reached_at"))
    )


def first_promise(
    log: DataFrame, item_type: str | None = "Shipment", field: str = "shipment_expected_to"
) -> DataFrame:
    """Smallest promised value (as text) an update ever set for each entity.

    ``item_type`` None reads every entity type; identifiers that are unique over all
    types give the same result, at the cost of reading the whole log.
    """
    rows = log if item_type is None else log_of(log, item_type)
    rows = rows.where((F.col("event") == "update") & may_hold("object_changes", field) & has_key("object_changes", field))
    return rows.groupBy("item_id").agg(F.min(new_value("object_changes", field)).alias("first_promise"))


def error_episodes(
    log: DataFrame, item_type: str = "ShippingOrder", field: str = "status", value: str = "error", cuts: int = CUTS
) -> DataFrame:
    """Every entry into ``value`` with its earliest later exit; entries never left are dropped.

    Entries and exits of one instant are one, so the scan runs over the entity's distinct instants.
    """
    # The plain text test runs before any parsing.
    logged = log_of(log, item_type).where(may_hold("object_changes", value))
    rows = parse_once(logged, ["item_id", "created_at"], _pair=change_pair("object_changes", field)).select(
        "item_id",
        F.col("created_at").alias("entered_at"),
        F.coalesce(last_of("_pair") == value, F.lit(False)).alias("enters"),
        F.coalesce(old_of("_pair") == value, F.lit(False)).alias("leaves"),
    )
    rows = rows.where(F.col("enters") | F.col("leaves"))
    instants = rows.groupBy("item_id", "entered_at").agg(F.max("enters").alias("enters"), F.max("leaves").alias("leaves"))
    paired = next_instant(instants, ["item_id"], "entered_at", F.when(F.col("leaves"), F.col("entered_at")), "left_at", cuts)
    seconds = F.timestamp_diff("MICROSECOND", "entered_at", "left_at").cast("decimal(28,6)")
    return (
        paired.where(F.col("enters") & F.col("left_at").isNotNull())
        .select("item_id", "entered_at", "left_at")
        .withColumns(
            {
                "days": F.round(seconds / F.lit(86_400_000_000), 2).cast("decimal(18,2)"),
                "hours": F.round(seconds / F.lit(3_600_000_000), 2).cast("decimal(18,2)"),
            }
        )
    )


def first_seen(
    log: DataFrame, resolvers: Mapping[str, DataFrame], products: DataFrame, zone_mode: str = "utc_to_local"
) -> DataFrame:
    """Earliest local log time per SKU, over several entity types that belong to a product.

    ``resolvers`` maps entity type to a table with ``item_id`` (text) and ``product_id``.
    The log is reduced to one row per entity before any join.
    """
    per_item = (
        log_of(log, *resolvers)
        .groupBy("item_type", "item_id")
        .agg(F.min("created_at").alias("created_at"))
    )
    branches: list[DataFrame] = []
    for item_type, items in resolvers.items():
        rows = per_item.where(F.col("item_type") == item_type)
        branches.append(rows.join(items.select("item_id", "product_id"), "item_id").select("product_id", "created_at"))
    merged = branches[0]
    for branch in branches[1:]:
        merged = merged.unionByName(branch)
    per_product = merged.groupBy("product_id").agg(F.min("created_at").alias("created_at"))
    skus = products.where(F.col("sku").isNotNull()).select(F.col("id").alias("product_id"), "sku")
    return (
        per_product.join(skus, "product_id")
        .groupBy("sku")
        .agg(F.min(local_ts("created_at", mode=zone_mode)).alias("first_seen_at"))
        .withColumn("first_seen_on", fmt("first_seen_at", "dd/MM/yyyy"))
    )


def deliveries(log: DataFrame, status: str = "DELIVERED") -> DataFrame:
    """Sale-item log rows that reach a status, with the sale named by the snapshot."""
    rows = log_of(log, "SaleItem").where(may_hold("object_changes", status) | may_hold("object", status))
    changes = unpack_changes(rows, "status", ["sale_id"])
    return changes.where(F.col("value") == status).select(
        F.col("item_id").cast("bigint").alias("sale_item_id"), "sale_id", "created_at"
    )


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")
