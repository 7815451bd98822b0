"""Line dedup with a log-template tree.

A line's place in the tree is its token count and its leading tokens, with tokens that hold a digit as wildcards. The
leaf's templates are the masked line itself and, for longer lines, three that generalise every third token behind the
leading ones, so lines that differ in a variable field still meet in one. A template found in more than one document is
boilerplate: its lines are dropped from all documents but the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm.store import table, written

MIN_TOKENS = 5  # shorter lines are left alone
DEPTH = 2  # leading tokens that every template keeps
GENERAL_TOKENS = 12  # lines from here on also have the generalised templates
TOKEN = r"[^\x20\x09-\x0D]+"
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _without(c: int, depth: int) -> Callable[[Column, Column], Column]:
    """Keeps the leading tokens and, behind them, two of three."""
    return lambda token, i: (i < depth) | (i % 3 != c)


def template_keys(docs: DataFrame, keys: list[str], least: int = MIN_TOKENS, depth: int = DEPTH, general: int = GENERAL_TOKENS) -> DataFrame:
    """keys, line_no and the hashes of the line's templates, for each line of at least ``least`` tokens."""
    lines = docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD, "<*>")).otherwise(F.col("line"))
    lines = lines.select(*keys, "line_no", F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0)).alias("tokens")).filter(F.size("tokens") >= least)
    n, whole = F.size("tokens"), [F.xxhash64(F.lit(0), F.size("tokens"), "tokens")]
    loose = [F.xxhash64(F.lit(c + 1), n, F.filter("tokens", _without(c, depth))) for c in range(3)]
    return lines.select(*keys, "line_no", F.when(n >= general, F.array(*whole, *loose)).otherwise(F.array(*whole)).alias("templates"))


def drop_templates(docs: DataFrame, least: int = MIN_TOKENS, depth: int = DEPTH, general: int = GENERAL_TOKENS) -> DataFrame:
    """The rows of ``docs`` with text cleaned, and n_lines and n_dropped (long).

    The first document of a template is the one with the smallest doc_id (rows that share it, equal rows too, count as one
    document and keep their lines alike; null ids come last). Null and empty texts stay as they are, with 0 and 1 lines.
    All columns stay; n_lines and n_dropped replace any of those names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.withColumn("_doc", F.xxhash64("text"))
    keys = written(template_keys(keyed.select("doc_id", "_doc", "text"), ["doc_id", "_doc"], least, depth, general), "templates")
    found = keys.select("doc_id", "_doc", "line_no", F.explode("templates").alias("template"))
    # two documents if two ids (or, for null ids, two texts) have it: plain minima and maxima, which combine before the shuffle
    who = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("_doc").cast("string"))))
    recurring = (
        found.select("template", "doc_id", who.alias("who")).groupBy("template")
        .agg(F.min("doc_id").alias("first"), F.min("who").alias("low"), F.max("who").alias("high"))
        .filter("low <> high").select("template", "first", "low")
    )
    later = F.when(F.col("first").isNull(), F.xxhash64(F.concat(F.lit("text "), F.col("_doc").cast("string"))) != F.col("low")).otherwise(
        ~F.col("doc_id").eqNullSafe(F.col("first"))
    )
    dropped = (
        found.join(recurring, "template").filter(later).groupBy("doc_id", "_doc").agg(F.collect_set("line_no").alias("_dropped"))
    )
    joined = keyed.alias("d").join(
        dropped.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("d._doc").eqNullSafe(F.col("x._doc")), "left"
    ).select("d.*", "x._dropped")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n")
    )
    return joined.withColumn("_lines", lines).select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
    )


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates."""
    return drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
tokens AS (
  SELECT doc_id, line_no, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS t FROM lines),
templates AS (
  SELECT doc_id, line_no, c, len(t) AS n, CASE WHEN c = 3 THEN t ELSE list_filter(t, lambda x, i: i <= 2 OR (i - 1) % 3 <> c) END AS template
  FROM tokens, range(0, 4) AS kinds(c) WHERE len(t) >= 5 AND (c = 3 OR len(t) >= 12)),
recurring AS (
  SELECT c, n, template, min(doc_id) AS first FROM templates GROUP BY c, n, template HAVING min(doc_id) <> max(doc_id)),
dropped AS (
  SELECT DISTINCT doc_id, line_no FROM templates JOIN recurring USING (c, n, template) WHERE doc_id <> first)
SELECT l.doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE d.line_no IS NULL), '') AS text
FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.line_no = d.line_no GROUP BY l.doc_id
"""
