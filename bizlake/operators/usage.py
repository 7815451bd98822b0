"""Sign-in activity from the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.functions.changes import change_pair, last_of, may_hold, old_of
from bizlake.functions.time import month_start, week_start
from bizlake.operators.changelog import log_of, parse_once


def active_usage(log: DataFrame, since: str | None = "2025-05-01", field: str = "signin_token") -> DataFrame:
    """Sign-ins per user, month and Monday week.

    A sign-in is a token that had a value and lost it. The week is derived from the
    same time, so the in-week count always equals the total; both are returned.
    """
    rows = log_of(log, "User")
    if since is not None:
        # Also as a plain range on the stored column, so file statistics can prune.
        rows = rows.where(F.col("created_at") >= F.date_sub(F.lit(since).cast("date"), 7).cast("timestamp_ntz"))
    pairs = parse_once(
        rows.where(may_hold("object_changes", field)), ["item_id", "created_at"], _pair=change_pair("object_changes", field)
    )
    rows = pairs.where(old_of("_pair").isNotNull() & last_of("_pair").isNull()).select(
        "item_id", month_start("created_at").alias("month"), week_start("created_at").alias("week")
    )
    if since is not None:
        rows = rows.where(F.col("week") >= F.lit(since).cast("date"))
    return (
        rows.groupBy("item_id", "month", "week")
        .agg(F.count("*").alias("accesses"))
        .withColumn("accesses_in_week", F.col("accesses"))
    )
