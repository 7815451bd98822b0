"""Status changes of an entity and the time between stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.operators.hours import business_hours, with_moments
from bizlake.operators.ordered import CUTS, SLICE, neighbours, next_instant
from bizlake.operators.pairs import later_pairs

# Stages that open and close a production run.
START_STATUSES = ("TO_PRODUCE", "IN_PRODUCTION", "IN_QUOTATION")
END_STATUSES = ("QUALITY", "DELIVERED")


def status_pairs(
    events: DataFrame,
    key: str,
    ts: str = "at",
    status: str = "status",
    span: tuple[Sequence[str], Sequence[str]] | None = None,
    cuts: int = CUTS,
) -> DataFrame:
    """Every change from one status to a different next one, per entity.

    Events are ordered by (time, status). The first pair of an entity has no earlier
    pair to compare with and is dropped. Because the pair before (a, b) is (x, a),
    "differs from the pair before" is the same as a != b once x exists, so one look
    back and one look ahead in a single pass replace the self-join and the second lag.
    With ``span`` (start stages, end stages) the same pass adds ``first_start`` and ``last_end``,
    the entity's first time in a start stage and its last in an end stage.
    """
    rows = events.where(F.col(status).isNotNull() & (F.col(status) != ""))
    totals = {}
    if span is not None:
        starts, ends = span
        totals = {
            "first_start": ("min", F.when(F.col(status).isin(*starts), F.col(ts))),
            "last_end": ("max", F.when(F.col(status).isin(*ends), F.col(ts))),
        }
    seen = neighbours(
        rows, [key], [ts, status],
        previous={status: "_before"}, following={status: "current_status", ts: "current_at"}, totals=totals, cuts=cuts,
    )
    return (
        seen.where(F.col("_before").isNotNull() & (F.col("current_status") != F.col(status)))
        .withColumnsRenamed({status: "previous_status", ts: "previous_at"})
        .drop("_before")
    )


def stage_lead_time(
    events: DataFrame,
    key: str,
    ts: str = "at",
    status: str = "status",
    starts: Sequence[str] = START_STATUSES,
    ends: Sequence[str] = END_STATUSES,
    cuts: int = CUTS,
) -> DataFrame:
    """Every start-stage event with every later end-stage event of the entity, and its working hours.

    The pairs are the result: starts times ends of an entity. ``next_end`` gives one row per start instead.
    Events that have a ``_slice``, made in the order of ``ts``, keep it.
    """
    rows = events.where(F.col(status).isin(*starts, *ends)).select(key, ts, status, *([SLICE] if SLICE in events.columns else []))
    pairs = later_pairs(
        rows, [key], ts, {status: "start_status", ts: "started_at"}, {status: "end_status", ts: "ended_at"},
        is_first=F.col(status).isin(*starts), is_again=F.col(status).isin(*ends), cuts=cuts,
    )
    pairs, (start, end) = with_moments(pairs, "started_at", "ended_at")
    return pairs.withColumn("working_hours", business_hours(start, end)).select(key, "start_status", "started_at", "end_status", "ended_at", "working_hours")


def next_end(
    events: DataFrame,
    key: str,
    ts: str = "at",
    status: str = "status",
    starts: Sequence[str] = START_STATUSES,
    ends: Sequence[str] = END_STATUSES,
    cuts: int = CUTS,
) -> DataFrame:
    """Every start-stage event with the nearest later end-stage event of the entity, if any, and its working hours.

    Starts and ends lie in one ordered stream, through which the nearest end is carried back: work grows with the events, not
    with starts times ends. Of several ends at one time the first by status counts; equal starts give one row each time
    and status. Events without a time are left out. Events that have a ``_slice``, made in the order of ``ts``, keep it.

    Statuses travel as numbers, so that the aggregation keeps fixed-width buffers and does not sort.
    """
    starts, ends = sorted(set(starts)), sorted(set(ends))
    rows = events.where(F.col(status).isin(*starts, *ends) & F.col(ts).isNotNull())
    cut = [SLICE] if SLICE in events.columns else []
    began = {f"_start_{i}": F.max(F.when(F.col(status) == s, 1)) for i, s in enumerate(starts)}
    ended = F.min(F.coalesce(*[F.when(F.col(status) == s, i) for i, s in enumerate(ends)]))
    instants = rows.groupBy(key, ts, *cut).agg(*[c.alias(name) for name, c in began.items()], ended.alias("_end"))
    hit = F.when(F.col("_end").isNotNull(), F.struct(F.col(ts).alias("at"), F.col("_end").alias("status")))
    found = next_instant(instants, [key], ts, hit, "_next", cuts)
    begun = F.array_compact(F.array(*[F.when(F.col(name) == 1, F.lit(s)) for name, s in zip(began, starts, strict=True)]))
    return found.select(
        key, F.explode(begun).alias("start_status"), F.col(ts).alias("started_at"),
        F.get(F.array(*[F.lit(s) for s in ends]), F.col("_next.status")).alias("end_status"), F.col("_next.at").alias("ended_at"),
    ).withColumn("working_hours", business_hours("started_at", "ended_at"))


def stage_span(
    events: DataFrame,
    key: str,
    ts: str = "at",
    status: str = "status",
    starts: Sequence[str] = START_STATUSES,
    ends: Sequence[str] = END_STATUSES,
) -> DataFrame:
    """One row per entity: working hours from its first start stage to its last end stage."""
    span = events.groupBy(key).agg(
        F.min(F.when(F.col(status).isin(*starts), F.col(ts))).alias("started_at"),
        F.max(F.when(F.col(status).isin(*ends), F.col(ts))).alias("ended_at"),
    )
    return span.where(F.col("ended_at") > F.col("started_at")).withColumn(
        "working_hours", business_hours("started_at", "ended_at")
    )
