"""Left joins to a table in which one key may hold very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def with_missing(many: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``many`` plus one NULL-filled row for each of ``ids`` it does not hold.

    A left join to a table with many rows per key cannot be split where that table is
    hot. Completing the table first, over key columns only, leaves an inner join that
    the adaptive planner splits on the hot side.
    """
    known = many.select(*keys).distinct()
    missing = ids.select(*keys).join(known, list(keys), "left_anti")
    return many.unionByName(missing, allowMissingColumns=True)
