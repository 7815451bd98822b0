"""Access to the role tables, by name, from files or from a mapping."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlake.sources.schemas import LOG_MONTH, ROLES


class Tables:
    """Role name to DataFrame, built on first use: ``tables.sales``, ``tables['sales']``."""

    def __init__(self, spark: SparkSession, build: Callable[[str], DataFrame]):
        self.spark = spark
        self._build = build
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in ROLES:
            raise KeyError(f"unknown role table {name!r}")
        if name not in self._frames:
            self._frames[name] = check_columns(name, self._build(name))
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as error:
            raise AttributeError(str(error)) from error


def check_columns(name: str, df: DataFrame) -> DataFrame:
    """Fail early when a role table lacks a column; keep only the role's columns, and the month of a log stored by month."""
    wanted = [field.name for field in ROLES[name].fields]
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"table {name!r} lacks columns {missing}")
    if name == "versions" and LOG_MONTH in df.columns:
        wanted.append(LOG_MONTH)
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in wanted])


def from_parquet(spark: SparkSession, folder: str) -> Tables:
    """Role tables stored as ``<folder>/<role>.parquet`` (a file or a partitioned folder)."""
    return Tables(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))


def from_frames(spark: SparkSession, frames: Mapping[str, DataFrame]) -> Tables:
    """Role tables held in memory; roles that are not given are empty."""
    return Tables(
        spark, lambda name: frames[name] if name in frames else spark.createDataFrame([], ROLES[name])
    )
