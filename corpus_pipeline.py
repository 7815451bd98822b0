"""The corpus pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes each result as
Parquet in the shared folder and rereads it. All stages but the last return the columns of ``docs`` with their values, whatever
their names: a stage works on doc_id, text and source, and carries the row beside them in one column. Rows with nulls pass
where a stage has no reason to drop them; an empty table gives an empty one. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm.decontamination import contamination
from bizlake.llm.jaccard import similar_classes
from bizlake.llm.mixing import content_hash, mix_sources
from bizlake.llm.repetition import repetition
from bizlake.llm.store import table, written
from bizlake.llm.templates import drop_templates


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other values of the row in one column, where no name of theirs can meet one of a stage."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _restored(kept: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The carried rows with their columns, of which some may have changed."""
    found = {c: F.col("row").getField(c) for c in columns if c != "text"} | {"text": F.col("text")} | changed
    return kept.select(*[found[c].alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject. Equal rows have equal verdicts; ties do not arise."""
    return _restored(repetition(_carried(docs)).filter("rules.kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines of templates that an earlier document has; a document of which no word is left is dropped.

    n_chars, if there, follows the new text. Rows that share a doc_id count as one document.
    """
    cleaned = drop_templates(_carried(docs))
    cleaned = cleaned.filter(F.col("n_dropped").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {}
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, size).otherwise(F.col("row.n_chars"))
    return _restored(cleaned, docs.columns, **changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id (of equal rows, one)."""
    classes = similar_classes(docs)
    # of rows that share the smallest id, one text stays
    kept = classes.filter("n_shingles > 0 AND doc_id <=> component_id").groupBy("component_id").agg(F.min("text_id").alias("t")).withColumnRenamed("component_id", "c")
    named = _carried(docs).withColumn("text_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    # texts without words are linked with nothing, so they stay
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = named.filter(~wordless).alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.c")) & (F.col("d.text_id") == F.col("k.t")), "left_semi")
    return _restored(chosen.dropDuplicates(["doc_id", "text_id"]).unionByName(named.filter(wordless)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the benchmark contaminates. Rows that share a doc_id are judged by their own texts."""
    bad = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "text_hash").distinct()
    named = _carried(docs).withColumn("text_hash", F.xxhash64("text"))
    kept = named.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash")), "left_anti")
    return _restored(kept, docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies (how often) and taken (words, repeats counted), which replace columns so named.

    Equal rows are taken alike; rows without a source are a source of their own.
    """
    taken = mix_sources(docs.select("doc_id", "text", "source")).filter("copies > 0").select("doc_id", F.col("h").alias("h"), "copies", "taken").distinct()
    taken = taken.withColumnsRenamed({"doc_id": "id", "h": "hash"})
    named = _carried(docs).withColumn("h", content_hash(F.col("doc_id"), F.col("text")))
    joined = named.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")))
    own = [c for c in docs.columns if c not in ("copies", "taken")]
    return _restored(joined, [*own, "copies", "taken"], copies=F.col("copies"), taken=F.col("taken"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Suffix structures and components can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the cleaned documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
