"""One row, or the newest rows, per key.

The first row of a key is a rank of one, which Spark limits before the shuffle as well (``WindowGroupLimit``), so a hot
key sends at most one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ascending order (NULLs last); later columns break ties."""
    return _edge_per_key(df, keys, order, False, nulls_flag=lambda c: c.isNull())


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], nulls_last: bool = False) -> DataFrame:
    """The first row of each key in descending order; NULLs win as in PostgreSQL unless ``nulls_last``."""
    flag = (lambda c: c.isNotNull()) if nulls_last else (lambda c: c.isNull())
    return _edge_per_key(df, keys, order, True, nulls_flag=flag)


def _edge_per_key(df, keys, order, descending, nulls_flag) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranks = []
    for c in order:
        c = F.col(c) if isinstance(c, str) else c
        ranks += [nulls_flag(c), c]
    ranks += [F.col(c) for c in rest]  # ties end with the whole row
    ranks = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in ranks]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*ranks))
    return df.withColumn("_place", place).where("_place = 1").select(*keys, *rest)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], ts: str, post_filter: Column | None = None
) -> DataFrame:
    """All rows that carry the newest ``ts`` of their key (ties kept); rows without a key or ``ts`` have none.

    ``post_filter`` applies after the newest time is known, so a key whose newest
    rows fail it disappears. The rank is limited before the shuffle as well, so the input is read once
    and a map task sends only the newest rows it has of a key.
    """
    place = F.rank().over(W.partitionBy(*keys).orderBy(F.col(ts).desc()))
    rows = df.dropna(subset=[*keys, ts]).withColumn("_place", place).where("_place = 1").drop("_place")
    return rows if post_filter is None else rows.where(post_filter)


def newest_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, parts: int = 256) -> DataFrame:
    """Mark the last row of each key in ``order``; NULL keys form a key, and of equal rows one is marked.

    Every key is cut into ``parts`` by the rows' content, whatever its size: the last row of each part is found first, and
    of those, at most ``parts`` a key, the last. A key with very many rows is so never sorted by one task, and ``df`` is
    computed once.
    """
    down = [F.col(c).desc() for c in order]
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    rows = df.withColumn("_part", part)
    rows = rows.withColumn("_first", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*down)) == 1)
    # the parts' last rows meet; all others stay in their parts
    rows = rows.withColumn("_part", F.when(F.col("_first"), F.lit(-1)).otherwise(F.col("_part")))
    last = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*down)) == 1
    return rows.withColumn(out, F.col("_first") & last).drop("_part", "_first")


def latest_subscription(
    sales: DataFrame, subscriptions: DataFrame, plans: DataFrame
) -> DataFrame:
    """Plan name of the newest subscription of every company that has a sale."""
    plan_of = subscriptions.join(
        plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name")), "plan_id", "left"
    ).select("company_id", "created_at", "plan_name")
    newest = last_per_key(plan_of, ["company_id"], ["created_at", "plan_name"])
    buyers = sales.select("company_id").where(F.col("company_id").isNotNull()).distinct()
    return buyers.join(newest.select("company_id", "plan_name"), "company_id", "left")


def latest_purchase(sales: DataFrame) -> DataFrame:
    """Newest order of every company, cancelled orders aside."""
    orders = sales.where(F.col("status") != "CANCELED").select("company_id", "id", "order_date", "total_price")
    return last_per_key(orders, ["company_id"], ["order_date", "id"])
