"""The change log as files laid out by entity type and month.

Reports read one or two entity types and a span of time, while the log holds everything that ever changed. In this layout
both conditions choose folders: as constants they are applied when the files are listed, and as a join to a table of months
they are applied when that table is known (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlake.sources.schemas import LOG_MONTH, ROLES

LAYOUT = ("item_type", LOG_MONTH)


def month_of(c: str | Column) -> Column:
    """The folder of a time: its month as ``yyyy-MM`` text, which sorts like the time (years 0001 to 9999)."""
    return F.date_format(c, "yyyy-MM")


def write_log(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write log rows below ``path``, one folder per entity type and month.

    Rows of a folder are brought together so that files are few, and a folder with very many rows (one type may hold a third
    of the log) is split over several tasks and files by the adaptive planner. Rows without a type or time have folders of their own.
    """
    rows = log.withColumn(LOG_MONTH, month_of("created_at"))
    rows.hint("rebalance", *LAYOUT).write.mode(mode).partitionBy(*LAYOUT).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log written by ``write_log``, with its month; conditions on both layout columns leave folders unread."""
    schema = T.StructType([*ROLES["versions"].fields, T.StructField(LOG_MONTH, T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names)  # columns of the layout come last in the files
