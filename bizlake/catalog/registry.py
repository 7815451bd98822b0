"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlake.sources.star import star_sql, star_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types every SQL engine returns alike: decimals as double, dates as ISO text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def register(key: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under a key."""

    def add(build: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = lambda spark, sf_dir: portable(build(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return add


def register_roles(key: str, sql: str | None = None):
    """Register a function of the role tables derived from the star schema."""

    def add(build):
        register(key, sql)(lambda spark, sf_dir: build(star_tables(spark, sf_dir)))
        return build

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(roles: str, body: str) -> str:
    """SQL with the named role tables in front; ``body`` is a SELECT, or CTEs and a SELECT."""
    body = body.strip()
    joiner = ",\n" if body.lower().startswith("with ") else "\n"
    if joiner == ",\n":
        body = body[5:]
    return f"WITH {star_sql(*roles.split())}{joiner}{body}"


def loc(c: str) -> str:
    return f"(({c}) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo')"


def loc_text(c: str, pattern: str) -> str:
    return f"strftime({loc(c)}, '{pattern}')"


def agg_text(c: str) -> str:
    return f"string_agg(DISTINCT cast({c} AS varchar), ', ' ORDER BY cast({c} AS varchar))"


def label_sql(c: str, labels: dict[str, str], default: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    other = c if default is None else f"'{default}'"
    return f"CASE {c} {arms} ELSE {other} END"
