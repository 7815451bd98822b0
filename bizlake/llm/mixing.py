"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a budget of words. A row's hash is fixed by its content, so the words of a source below any hash
threshold can be read from a histogram over hash buckets. The bucket in which the budget runs out is split again, and
only that one, until it holds a single hash. Whole copies cover budgets above the source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlake.llm.store import table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
HASH_BITS, STEP_BITS = 56, 8
WORD = r"[^\x20\x09-\x0D]+"


def content_hash(doc_id: Column, text: Column) -> Column:
    """A number below 2**56 fixed by the row's id and text; only repeated rows have equal ones, but for chance."""
    digest = F.md5(F.concat_ws("|", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Target words for each row of ``sizes`` (source, source_size).

    The budget is shared by weight; a source stops at ``most`` times its size and its excess goes to the others by
    weight. That ends at one water level: targets are min(most * size, level * weight). One row per source is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("budget", F.sum("source_size").over(everyone) * float(share)).withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    )
    # a source is full if its own level, with all that fill earlier being full, reaches its cap
    level = F.max(F.when(F.col("fill") > F.col("level"), F.col("level"))).over(everyone)
    return rows.withColumn("target", F.when(level.isNull() | (F.col("fill") <= level), F.col("cap")).otherwise(level * F.col("w"))).select(
        "source", "source_size", "target"
    )


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """source, copies, threshold: rows whose hash is below the threshold are taken once more than ``copies`` times."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.withColumn("copies", full.cast("long")).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = written(state.select("source", "source_size", "target", "copies", "need", F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("done")), "mix-state")
    for depth in range(1, HASH_BITS // STEP_BITS + 1):
        shift = HASH_BITS - depth * STEP_BITS
        # the key (source, prefix) spreads a hot source over the buckets of the levels before
        inside = rows.withColumn("prefix", F.shiftright("h", shift + STEP_BITS)).alias("r").join(
            state.filter(~F.col("done")).select(F.col("source").alias("s"), F.col("prefix").alias("p")),
            F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")), "left_semi",
        )
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        buckets = buckets.withColumn("upto", upto).select(F.col("source").alias("s"), "bucket", "words", "low", "high", "upto")
        # the first bucket that reaches the need
        cut = (
            state.filter(~F.col("done")).join(buckets, F.col("source").eqNullSafe(F.col("s")))
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")) & (F.col("words") > 0))
        )
        rest = F.col("need") - (F.col("upto") - F.col("words"))
        single = F.col("low") == F.col("high")
        nearer = F.when(2 * rest >= F.col("words"), F.col("low") + 1).otherwise(F.col("low"))
        cut = cut.select(
            "source", "source_size", "target", "copies", rest.alias("need"),
            F.when(single, nearer).otherwise(F.col("bucket")).alias("prefix"), single.alias("done"),
        )
        # what needs nothing, or is settled, stays
        settled = state.filter(F.col("done"))
        none = state.filter(~F.col("done") & (F.col("need") <= 0)).withColumn("prefix", F.lit(0).cast("long")).withColumn("done", F.lit(True))
        state = written(settled.unionByName(none).unionByName(cut), f"mix-level{depth}")
        if state.filter(~F.col("done")).limit(1).count() == 0:
            break
    return state.select("source", "source_size", "target", "copies", F.when(F.col("done"), F.col("prefix")).otherwise(F.col("prefix") + 1).alias("threshold"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, any others) with size, source_size, target and taken.

    A row is taken 0, 1 or more times as a whole; taken counts its words, repeats included. Null texts have size 0, null
    sources are one source, equal rows are taken alike, an empty table gives no rows. Other columns, also
    ones that are named like the new ones, are left to the caller: the result has doc_id, source, h and the new ones.
    """
    rows = written(
        docs.select(
            "doc_id", "source", content_hash(F.col("doc_id"), F.col("text")).alias("h"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = _thresholds(rows, source_targets(sizes, weights, share, most))
    # thresholds go out once per value of the top hash bits, so no task gets a whole source
    salts = 1 << STEP_BITS
    cuts = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "s")
    salted = rows.withColumn("salt", F.shiftright("h", HASH_BITS - STEP_BITS).cast("int"))
    times = F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return salted.join(cuts.withColumnRenamed("salt", "t"), F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t"))).select(
        "doc_id", "source", "h", "size", "source_size", "target", times.cast("int").alias("copies"), (times * F.col("size")).alias("taken")
    )


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 14))::BIGINT AS h
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM rows GROUP BY source),
fills AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS fill FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM fills),
water AS (SELECT max(level) FILTER (WHERE fill > level) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN water.level IS NULL OR fill <= water.level THEN cap ELSE water.level * w END AS target
  FROM levels, water),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
groups AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM rows GROUP BY source, h)
SELECT r.doc_id, r.size, n.source_size, n.target,
       r.size * (n.copies + CASE WHEN n.target - n.copies * n.source_size > 0
                                  AND 2 * (n.target - n.copies * n.source_size - (g.upto - g.words)) >= g.words
                                  AND (n.target - n.copies * n.source_size - (g.upto - g.words)) > 0 THEN 1 ELSE 0 END) AS taken
FROM rows r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source
JOIN groups g ON r.source IS NOT DISTINCT FROM g.source AND r.h = g.h
"""
