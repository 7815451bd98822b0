"""Folding the rows of each group in order, as a stream: no group is ever held in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    result: str,
    begin: Callable[[], Any],
    step: Callable[..., None],
    end: Callable[[Any], Iterable[tuple]],
) -> DataFrame:
    """``keys`` and the columns of ``result`` (DDL): for each group, the rows that ``end`` makes of a state that ``step`` took through it.

    Spark sorts the rows by key and ``order`` (nulls first); a task reads them as a stream and holds one batch and one
    state. One task reads a group from its first row to its last, which a digest over a whole group asks for; callers
    make the rows of large groups few. Null keys form a group of their own, equal rows stay, no rows give no group.
    """
    fields = [rows.schema[k] for k in keys] + list(T._parse_datatype_string(result).fields)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow, width, own = to_arrow_schema(schema), len(keys), [*keys, *values]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, state, done = None, None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in own], strict=True):
                if state is None or row[:width] != have:
                    if state is not None:
                        done += [(*have, *made) for made in end(state)]
                    have, state = row[:width], begin()
                step(state, *row[width:])
            if done:
                yield _batch(done, arrow)
                done = []
        if state is not None and (done := [(*have, *made) for made in end(state)]):
            yield _batch(done, arrow)

    needed = list(dict.fromkeys([*keys, *order, *values]))
    return rows.select(*needed).repartition(*keys).sortWithinPartitions(*keys, *order).select(*own).mapInArrow(fold, schema)


def _batch(done: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)


def joined_digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, separator: bytes = b"") -> DataFrame:
    """``keys`` and ``out``: the SHA-256 (lowercase hex) of each group's texts, joined in order. A null text counts as empty."""

    def step(state: list, text: str | None) -> None:
        if state[1]:
            state[0].update(separator)
        state[0].update((text or "").encode())
        state[1] = True

    return ordered_fold(rows, keys, order, [value], f"{out} string", lambda: [hashlib.sha256(), False], step, lambda s: [(s[0].hexdigest(),)])
