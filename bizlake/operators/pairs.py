"""All pairs of an earlier and a later row of one key, made block by block.

The pairs are the result, so their number grows with the square of a key's rows; what must not grow is the share of one task.
A key's time is cut into the slices of ``ordered.sliced``; each pair of slices that can hold a pair of rows is a join key of
its own, so both sides of a large key are split and no two slices meet for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlake.operators.ordered import CUTS, SLICE, same, sliced


def later_pairs(
    df: DataFrame,
    keys: Sequence[str],
    on: str,
    first: dict[str, str],
    again: dict[str, str],
    *,
    is_first: Column | None = None,
    is_again: Column | None = None,
    min_days: int | None = None,
    cuts: int = CUTS,
) -> DataFrame:
    """``keys`` and the columns of both rows (``first``/``again`` map source to new name, ``on`` included) of every pair of rows with
    a later ``on`` in the second, at least ``min_days`` calendar days later if given.

    Rows with a NULL key or NULL ``on`` have no pairs. Equal rows pair once each.
    """
    rows = df.dropna(subset=[*keys, on])
    # a row's other values split what lies at one time
    rows = sliced(rows.withColumn("_tie", F.xxhash64(*rows.columns)), keys, [on, "_tie"], cuts).drop("_tie")
    # at most 2 * cuts slices in all; a key that is not cut meets itself
    extent = rows.where(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(F.min(on).alias("low"), F.max(on).alias("high"))
    extents = extent.groupBy(*[F.col(k).alias(f"_on_{k}") for k in keys]).agg(F.collect_list(F.struct(SLICE, "low", "high")).alias("_all"))

    def apart(early: Column, late: Column) -> Column:
        return (late > early) if min_days is None else (late > early) & (F.datediff(late, early) >= min_days)

    def side(own: str, other: str, columns: dict[str, str], chosen: Column | None) -> DataFrame:
        part = (rows if chosen is None else rows.where(chosen)).join(F.broadcast(extents), same(keys), "left")
        if own == "_here":
            partners = F.filter("_all", lambda x: (x[SLICE] >= F.col(SLICE)) & apart(F.col(on), x["high"]))
        else:
            partners = F.filter("_all", lambda x: (x[SLICE] <= F.col(SLICE)) & apart(x["low"], F.col(on)))
        blocks = F.when(F.col(SLICE) == 0, F.array(F.lit(0))).otherwise(F.transform(partners, lambda x: x[SLICE]))
        return part.select(*keys, F.col(SLICE).alias(own), F.explode(blocks).alias(other), *[F.col(c).alias(new) for c, new in columns.items()])

    left = side("_here", "_there", first, is_first)
    right = side("_there", "_here", again, is_again)
    return left.join(right, [*keys, "_here", "_there"]).where(apart(F.col(first[on]), F.col(again[on]))).drop("_here", "_there")
