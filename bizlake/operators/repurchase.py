"""Repeat purchases of the same article by the same company."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.operators.ordered import CUTS
from bizlake.operators.pairs import later_pairs


def repurchase(
    sales: DataFrame, keys: Sequence[str], on: str, carry: Sequence[str], min_days: int = 30, cuts: int = CUTS
) -> DataFrame:
    """Every earlier purchase with every later one at least ``min_days`` after it.

    The pairs are the report. ``first_*`` columns come from the earlier purchase and
    ``again_*`` from the later. Rows with a NULL key or day have no pairs.
    """
    first, again = ({c: f"{side}_{c}" for c in [on, *carry]} for side in ("first", "again"))
    pairs = later_pairs(sales.select(*keys, on, *carry), keys, on, first, again, min_days=min_days, cuts=cuts)
    return pairs.withColumn("days_between", F.datediff(f"again_{on}", f"first_{on}"))
