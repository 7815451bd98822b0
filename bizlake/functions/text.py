"""Text helpers that keep PostgreSQL's NULL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizlake.functions.time import col


def concat_skip_null(*parts: str | Column) -> Column:
    """CONCAT: NULL parts count as empty text."""
    return F.concat_ws("", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def string_agg_distinct(c: str | Column, where: Column | None = None, sep: str = ", ") -> Column:
    """Aggregate: sorted distinct values joined by ``sep``; NULL when there are none."""
    value = col(c).cast("string")
    if where is not None:
        value = F.when(where, value)
    values = F.collect_set(value)
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), sep))


def decimal_comma(c: str | Column) -> Column:
    return F.replace(col(c).cast("string"), F.lit("."), F.lit(","))


def first_part(c: str | Column, sep: str = "-") -> Column:
    return F.trim(F.split_part(col(c), F.lit(sep), F.lit(1)))


def matching_descriptions(
    events_json: str | Column, pattern: str, field: str = "description", sep: str = ", "
) -> Column:
    """Distinct ``field`` texts of a JSON array that match ``pattern`` (ILIKE), sorted and joined."""
    events = F.from_json(col(events_json), f"array<struct<{field}:string>>")
    texts = F.transform(events, lambda e: e[field])
    hits = F.array_sort(F.array_distinct(F.filter(texts, lambda x: x.ilike(pattern))))
    return F.when(F.size(hits) > 0, F.array_join(hits, sep))
