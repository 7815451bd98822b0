"""Ordered scans per key: neighbours, running aggregates, next match.

A scan sorts the rows of a key, and one key may hold a third of all rows. So every key is cut, whatever its size, at points
that the data give: of all (key, order) values the ``cuts`` with the smallest hashes are the cut points, so a key gets cut
points in proportion to its rows, also where all of them bear one time. A slice of a key is what lies between two of its cut
points; most keys have none and stay whole. Each slice is scanned on its own, and one row per slice of a cut key carries the
state over the borders; there are at most ``2 * cuts`` such rows, whatever the size of the data, so they are broadcast.

The cut points depend on nothing but the rows' content: every branch of a plan and every task that runs again finds the same
slices, and no job runs before the query does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUTS = 1024
SLICE = "_slice"


def same(columns: Sequence[str], prefix: str = "_on_") -> Column:
    """Equality of columns with their prefixed namesakes in which NULL equals NULL."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns])


def _attach(rows: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a table with at most one row per ``on`` and a number of rows that ``cuts`` bounds."""
    named = few.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return rows.join(F.broadcast(named), same(on), "left").drop(*[f"_on_{c}" for c in on])


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """``keys`` and ``_cuts``, the sorted cut points of the keys that have any: at most ``cuts`` points in all.

    Of rows with equal values one point is made; where such rows fill the sample, there are fewer points.
    """
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sample = df.select(*keys, at.alias("_at"), F.xxhash64(*keys, *order).alias("_h")).orderBy("_h").limit(cuts)
    # Behind an exchange the pass over the rows is a stage of its own, which no broadcast waits for against its time limit.
    return sample.repartition(*keys).groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """``df`` with the number of the row's slice: 0 for a key without cut points, else from 1 in the order of ``order``.

    ``order`` may be a prefix of the order that a later scan takes. Rows that have a ``_slice`` keep it, so slices can be found
    on the columns that are cheap to read, before the others are made.
    """
    if SLICE in df.columns:
        return df
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(cuts, 1).bit_length()))])

    def step(low: Column, width: Column) -> Column:
        return F.when(F.get("_cuts", low + width - 1) <= at, low + width).otherwise(low)

    # bisection: how many cut points are at or before the row
    place = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(1), lambda low, w: step(low - 1, w) + 1))
    return _attach(df, cut_points(df, keys, order, cuts), keys).withColumn(SLICE, place).drop("_cuts")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    sequence: str | None = None,
    totals: Mapping[str, tuple[str, str | Column]] | None = None,
    cuts: int = CUTS,
) -> DataFrame:
    """Add values of the previous and the following row of the same key, a row number from 1, and aggregates over the key.

    ``previous``/``following`` map source column to new column, ``totals`` new column to (sum, min or max; value). Rows that are equal in ``order`` come in any order, so it should
    tell all rows apart that differ. NULL keys form a key, NULLs in ``order`` come first.
    """
    previous, following = dict(previous or {}), dict(following or {})
    carried = list(dict.fromkeys([*previous, *following]))
    rows = sliced(df, keys, order, cuts)
    ends = F.struct(*order, *[c for c in carried if c not in order])
    made = {out: getattr(F, kind)(F.col(c) if isinstance(c, str) else c) for out, (kind, c) in (totals or {}).items()}
    borders = rows.where(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(
        F.min(ends).alias("_first"), F.max(ends).alias("_last"), F.count("*").alias("_n"), *[f.alias(out) for out, f in made.items()]
    )
    over = W.partitionBy(*keys).orderBy(SLICE)
    borders = borders.select(
        *keys,
        SLICE,
        F.lag("_last").over(over).alias("_slice_before"),
        F.lead("_first").over(over).alias("_slice_after"),
        F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_slice_skip"),
        *[getattr(F, kind)(out).over(W.partitionBy(*keys)).alias(f"_slice_{out}") for out, (kind, _) in (totals or {}).items()],
    )
    w = W.partitionBy(*keys, SLICE).orderBy(*order)
    new = {out: F.lag(c).over(w) for c, out in previous.items()} | {out: F.lead(c).over(w) for c, out in following.items()}
    new |= {out: f.over(W.partitionBy(*keys, SLICE)) for out, f in made.items()}
    fixed = {out: F.when(F.col(SLICE) > 0, F.col(f"_slice_{out}")).otherwise(F.col(out)) for out in made}
    if previous or sequence:
        new["_slice_row"] = F.row_number().over(w)
    if following:
        new["_slice_more"] = F.lead(F.lit(True)).over(w)
    fixed |= {out: F.when(F.col("_slice_row") == 1, F.col(f"_slice_before.{c}")).otherwise(F.col(out)) for c, out in previous.items()}
    fixed |= {out: F.when(F.col("_slice_more").isNull(), F.col(f"_slice_after.{c}")).otherwise(F.col(out)) for c, out in following.items()}
    if sequence:
        fixed[sequence] = F.col("_slice_row").cast("bigint") + F.coalesce("_slice_skip", F.lit(0))
    done = _attach(rows.withColumns(new), borders, [*keys, SLICE]).withColumns(fixed)
    return done.drop(SLICE, "_slice_before", "_slice_after", "_slice_skip", "_slice_row", "_slice_more", *[f"_slice_{out}" for out in made])


# How a value inside a slice joins the value carried from the slices before it.
_COMBINED = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "bit_xor": lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b),
    "min": F.least,
    "max": F.greatest,
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, str | Column]],
    *,
    reverse: bool = False,
    inclusive: bool = True,
    cuts: int = CUTS,
) -> DataFrame:
    """Add aggregates over all rows of the key up to this one: ``values`` maps new column to (sum, min, max or bit_xor; value).

    ``reverse`` takes the rows from this one on; without ``inclusive`` this row itself is left out. Rows that are equal in
    ``order`` come in any order.
    """
    rows = sliced(df, keys, order, cuts)
    made = {out: getattr(F, kind)(F.col(c) if isinstance(c, str) else c) for out, (kind, c) in values.items()}
    borders = rows.where(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(*[f.alias(out) for out, f in made.items()])
    place = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
    before = W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    borders = borders.select(*keys, SLICE, *[getattr(F, kind)(out).over(before).alias(f"_c_{out}") for out, (kind, _) in values.items()])
    turned = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    w = W.partitionBy(*keys, SLICE).orderBy(*turned).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    done = _attach(rows.withColumns({out: f.over(w) for out, f in made.items()}), borders, [*keys, SLICE])
    both = {out: _COMBINED[kind](F.col(out), F.col(f"_c_{out}")) for out, (kind, _) in values.items()}
    return done.withColumns(both).drop(SLICE, *[f"_c_{out}" for out in values])


def next_instant(
    instants: DataFrame, keys: Sequence[str], ts: str, value: Column, out: str, cuts: int = CUTS
) -> DataFrame:
    """For rows with one time each per key: the earliest non-NULL ``value`` at a strictly later time.

    ``value`` begins with the time, as a time or as a struct. A row without a time has no later one.
    """
    found = running(instants.withColumn("_hit", value), keys, [ts], {out: ("min", "_hit")}, reverse=True, inclusive=False, cuts=cuts)
    return found.withColumn(out, F.when(F.col(ts).isNotNull(), F.col(out))).drop("_hit")


def _back(df: DataFrame, instants: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row with what its instant was given; the adaptive planner can split an instant with very many rows."""
    named = instants.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return df.join(named, same(on)).drop(*[f"_on_{c}" for c in on])


def next_match(df: DataFrame, keys: Sequence[str], ts: str, matches: Column, out: str, *, cuts: int = CUTS) -> DataFrame:
    """Add the earliest time strictly after this row at which ``matches`` holds for the same key.

    Rows of one instant get one answer, so the scan runs over the distinct instants.
    """
    instants = df.groupBy(*keys, ts).agg(F.max(F.coalesce(matches, F.lit(False))).alias("_any"))
    found = next_instant(instants, keys, ts, F.when(F.col("_any"), F.col(ts)), out, cuts)
    return _back(df, found.select(*keys, ts, out), [*keys, ts])


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, *, cuts: int = CUTS) -> DataFrame:
    """Add the sum of ``value`` over all rows of the key up to this time (equal times included, rows without a time first)."""
    instants = df.groupBy(*keys, ts).agg(F.sum(value).alias("_sum"))
    found = running(instants, keys, [ts], {out: ("sum", "_sum")}, cuts=cuts)
    return _back(df, found.select(*keys, ts, out), [*keys, ts])
