"""Benchmark decontamination by winnowing.

Of the k-gram hashes in every sliding window of w, the smallest is kept as a fingerprint. Two texts that share
k + w - 1 words in a row share a fingerprint at the same place of that run, so joining the fingerprints of documents and
benchmark items finds every such run. Each hit is then extended along its diagonal over the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm import words as wd
from bizlake.llm.store import table, written

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(n: int) -> tuple[int, int]:
    """k and w whose guarantee, k + w - 1, is n words."""
    k = (n + 1) // 2
    return k, n - k + 1


def winnow(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (rising) and values of the fingerprints that cover every run of n words within one text."""
    k, w = split(n)
    g = wd.grams(h, k)
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, place = g[:m].copy(), np.arange(m)
    for j in range(1, w):
        less = g[j : j + m] < best  # ties keep the first, in every text alike
        best[less] = g[j : j + m][less]
        place[less] = np.flatnonzero(less) + j
    kept = wd.distinct(place[doc[:m] == doc[n - 1 : n - 1 + m]])
    return kept, wd.mix(g[kept] + np.uint64(n))


def fingerprints(docs: DataFrame, lengths: list[int], keys: list[str]) -> DataFrame:
    """keys, pos, fp: the fingerprints of ``docs.text`` for each guaranteed length."""
    schema = docs.select(*keys, F.lit(0).cast("int").alias("pos"), F.lit(0).cast("long").alias("fp")).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            w = wd.words_of(wd.texts_of(batch.column("text")), wd.ALPHANUMERIC)
            first = np.searchsorted(w.doc, np.arange(batch.num_rows))
            for n in lengths:
                at, fp = winnow(w.hash, w.doc, n)
                rows = w.doc[at]
                out = batch.select(keys).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array((at - first[rows]).astype(np.int32)), pa.array(fp.view(np.int64))], names=[*keys, "pos", "fp"]
                )

    return docs.select(*keys, "text").mapInArrow(find, schema)


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and n_words of each row; null has no words."""
    schema = docs.select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_words")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            texts = wd.texts_of(batch.column("text"))
            doc = wd.spans(texts, wd.ALPHANUMERIC[texts.data])[2]
            n = pa.array(np.bincount(doc, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), n], names=["doc_id", "text_hash", "n_words"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(count, schema)


def _hit_runs(doc: np.ndarray, item: np.ndarray, diagonals: list[int], window: int, hit: np.ndarray) -> bool:
    """Flag the words of ``doc`` in runs equal to ``item`` along the diagonals that hold a whole window; whether there is one."""
    need, found = min(window, len(item)), False
    for d in diagonals:
        low, high = max(0, d), min(len(doc), d + len(item))
        if high - low < need:
            continue
        equal = np.zeros(high - low + 2, np.int8)
        equal[1:-1] = doc[low:high] == item[low - d : high - d]
        edges = np.flatnonzero(np.diff(equal))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= need:
                hit[low + a : low + b] = True
                found = True
    return found


def _verified(pairs: DataFrame, window: int) -> DataFrame:
    """Extends the hits: ``pairs`` has a document's key and text and its candidate items with their words and diagonals."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            w = wd.words_of(wd.texts_of(batch.column("text")), wd.ALPHANUMERIC)
            edges = np.searchsorted(w.doc, np.arange(batch.num_rows + 1))
            hits, found = [], []
            for row, items in enumerate(batch.column("items").to_pylist()):
                own = w.hash[edges[row] : edges[row + 1]]
                flags = np.zeros(len(own), bool)
                texts = wd.texts_of(pa.array([x["words"] for x in items], pa.string()))
                iw = wd.words_of(texts, wd.ALPHANUMERIC)
                at = np.searchsorted(iw.doc, np.arange(len(items) + 1))
                found.append([x["item"] for i, x in enumerate(items) if _hit_runs(own, iw.hash[at[i] : at[i + 1]], x["diagonals"], window, flags)])
                hits.append(int(flags.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_hit", "items"],
            )

    schema = pairs.select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_hit"), F.array(F.lit(0).cast("long")).alias("items")).schema
    return pairs.mapInArrow(extend, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items (ids as sorted strings) and contaminated for each row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Null and empty texts have no words and no windows; an
    item of fewer words than a window is one window. Repeated rows have equal results, a null doc_id is kept, a null
    item_id counts as the id "". Any other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    norm = F.array_join(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0)), " ")
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), norm.alias("words")).filter("words <> ''")
    named = named.withColumn("item", F.xxhash64("words"))
    items = written(named.groupBy("item").agg(F.first("words").alias("words"), F.size(F.split(F.first("words"), " ")).alias("n")), "items")
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(window))).distinct().collect())  # at most ``window`` numbers
    item_fps = [
        fingerprints(items.filter(F.least("n", F.lit(window)) == n).select("item", F.col("words").alias("text")), [n], ["item"]) for n in lengths
    ]
    own = _sizes(docs)
    if not item_fps:
        none = F.lit(0).cast("long")
        return own.select("*", none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    tests = item_fps[0]
    for x in item_fps[1:]:
        tests = tests.unionByName(x)
    tests = written(tests.withColumnRenamed("pos", "item_pos"), "item-fingerprints")  # Spark knows its size, and picks the join by it
    same_doc = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    hits = (
        fingerprints(docs, lengths, ["doc_id", "text_hash"]).join(tests, "fp")
        .select("doc_id", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .groupBy("doc_id", "text_hash", "item").agg(F.collect_set("diagonal").alias("diagonals"))
        .join(items.select("item", "words"), "item")
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "words", "diagonals")).alias("items"))
    )
    pairs = docs.alias("d").join(hits.alias("h"), same_doc("d", "h")).select("d.doc_id", "d.text_hash", "d.text", "h.items")
    found = _verified(pairs, window).filter("n_hit > 0").dropDuplicates(["doc_id", "text_hash"])
    found = written(found, "contaminated")
    ids = (
        found.select("doc_id", "text_hash", F.explode("items").alias("item")).join(named.select("item", "item_id"), "item")
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    found = found.select("doc_id", "text_hash", "n_hit").alias("f").join(ids.alias("i"), same_doc("f", "i")).select("f.*", "i.items")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    listed = F.coalesce(F.col("f.items"), F.array().cast("array<string>"))
    return own.alias("o").join(found.alias("f"), same_doc("o", "f"), "left").select(
        "o.doc_id", "o.text_hash", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by the whole benchmark."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
iw AS (
  SELECT item_id::VARCHAR AS item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
windows AS (
  SELECT item_id, least(n, 13) AS n, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram, p, n - least(n, 13) + 1 AS last
  FROM iw),
kept AS (SELECT DISTINCT item_id, n, gram FROM windows WHERE p <= last),
lengths AS (SELECT DISTINCT n FROM kept),
grams AS (
  SELECT doc_id, p, count(*) OVER w AS n, string_agg(word, ' ') OVER w AS gram
  FROM dw WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
hits AS (
  SELECT DISTINCT doc_id, g.p, k.item_id, k.n FROM grams g JOIN kept k ON g.n = k.n AND g.gram = k.gram),
marked AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""
