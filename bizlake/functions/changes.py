"""Reading the JSON columns of a change log.

Parsing is the dear part, so the helpers come in two kinds: ``may_hold`` is a plain
text test that skips rows before they are parsed, and ``change_pair`` parses once per
use and should be put in a column when several of its elements are needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizlake.functions.time import col


def may_hold(text: str | Column, word: str) -> Column:
    """The JSON text may contain the word, as a key or as a value of any type; a superset of any exact test.

    Without a backslash nothing is escaped, so the word would be there as it is; with one, only parsing can tell.
    """
    return col(text).contains(word) | col(text).contains("\\")


def change_pair(changes: str | Column, field: str) -> Column:
    """``[old, new]`` of one field as an array of text; JSON null becomes NULL."""
    return F.from_json(col(changes), f"struct<`{field}`:array<string>>")[field]


def old_of(pair: str | Column) -> Column:
    return F.get(col(pair), F.lit(0))


def new_of(pair: str | Column) -> Column:
    return F.get(col(pair), F.lit(1))


def last_of(pair: str | Column) -> Column:
    return F.try_element_at(col(pair), F.lit(-1))


def new_value(changes: str | Column, field: str) -> Column:
    return new_of(change_pair(changes, field))


def snapshot_value(snapshot: str | Column, field: str) -> Column:
    return F.from_json(col(snapshot), f"struct<`{field}`:string>")[field]


def has_key(changes: str | Column, field: str) -> Column:
    return F.array_contains(F.json_object_keys(col(changes)), field)
