"""Role tables with text identifiers and values: the star-schema role tables with every numeric identifier turned into text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlake.sources.schemas import ROLES
from bizlake.sources.tables import Tables

NUMBERED = ("SaleItem",)  # entity types whose identifiers are numbers in the reports' own schema


def as_text(name: str, df: DataFrame) -> DataFrame:
    """Numbers where the role has text become text, and identifiers begin with a letter, so that no cast can read them."""
    made = {}
    for field in ROLES[name].fields:
        own = df.schema[field.name].dataType
        if isinstance(field.dataType, T.StringType) and not isinstance(own, T.StringType):
            text = F.col(field.name).cast("string")
            is_id = field.name == "id" or field.name.endswith("_id")
            made[field.name] = F.concat(F.lit("u"), text) if is_id else text
    if name == "versions":
        made["item_id"] = F.when(F.col("item_type").isin(*NUMBERED), F.col("item_id")).otherwise(F.concat(F.lit("u"), "item_id"))
        made["object"] = F.regexp_replace("object", r'"sale_id":(\d+)', '"sale_id":"u$1"')
        made["object_changes"] = F.regexp_replace("object_changes", r'("quote_item_id":\[null,")', "$1u")
    return df.withColumns(made)


def text_tables(tables: Tables) -> Tables:
    return Tables(tables.spark, lambda name: as_text(name, tables[name]))


def plain_rows(df: DataFrame) -> list[tuple]:
    """The rows as text, without the letter before identifiers."""
    return sorted(tuple("" if v is None else re.sub(r"u(?=\d)", "", str(v)) for v in row) for row in df.collect())


if __name__ == "__main__":
    import sys

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from bizlake.session import build_session
    from bizlake.sources.star import star_tables
    from test_reports import REPORTS

    session = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    numbers = star_tables(session, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
    for key, report in REPORTS.items():
        print(key, "same" if plain_rows(report(numbers)) == plain_rows(report(text_tables(numbers))) else "DIFFERENT", flush=True)
