"""Quality rules: repetition found with a suffix array, beside plain counts.

The suffixes of all texts of a chunk are sorted together by doubling; suffixes of different texts never compare equal.
Neighbours with a longest common prefix of enough words are the occurrences of maximal repeated substrings. The union of
their spans gives the covered fraction of a text; the longest prefix is its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm import words as wd
from bizlake.llm.store import table

MIN_REPEAT = 6  # words of a repeat that counts
MOST_COVERED = 0.4  # fraction of the words in repeats
MOST_LONGEST = 0.35  # words of the longest repeat, as a fraction of all
MIN_WORDS = 50
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def suffix_array(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted suffixes, and the ranks by their first 1, 2, 4, … words.

    Ranks at a level are equal only for suffixes of one text that agree in that many words.
    """
    n = len(h)
    end = np.searchsorted(doc, doc, "right")  # the word after a text's last
    _, rank, count = np.unique(wd.mix(h ^ wd.mix(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    start = np.cumsum(count) - count
    rank, tied, levels, size = start[rank], count[rank] > 1, [], 1
    while True:
        levels.append(rank)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        follower = at + size
        inside = follower < end[at]
        second = np.where(inside, rank[np.minimum(follower, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[at]))
        at, second = at[order], second[order]
        first = rank[at]
        new_group = np.ones(len(at), bool)
        new_group[1:] = first[1:] != first[:-1]
        new_rank = new_group.copy()
        new_rank[1:] |= second[1:] != second[:-1]
        position = np.arange(len(at))
        within = position - np.maximum.accumulate(np.where(new_group, position, 0))
        lead = np.maximum.accumulate(np.where(new_rank, position, 0))
        rank = rank.copy()
        rank[at] = first + within[lead]
        sizes = np.diff(np.append(np.flatnonzero(new_rank), len(at)))
        tied = np.zeros(n, bool)
        tied[at] = np.repeat(sizes, sizes) > 1
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Words that each sorted suffix has in common with the next one (of the same text)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    same, out = doc[a] == doc[b], np.zeros(max(0, n - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        inside = same & (a < n) & (b < n)
        at = np.flatnonzero(inside)
        at = at[(doc[a[at]] == doc[b[at]]) & (doc[a[at]] == doc[order[at]]) & (rank[a[at]] == rank[b[at]])]
        out[at] += 1 << level
        a[at] += 1 << level
        b[at] += 1 << level
    return out


def repeats(h: np.ndarray, doc: np.ndarray, texts: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the words in the union of its repeats of ``least`` words or more, and the longest repeat."""
    n = len(h)
    longest, covered = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if n < 2:
        return covered, longest
    order, levels = suffix_array(h, doc)
    common = common_prefixes(order, levels, doc)
    length = np.zeros(n, np.int64)
    np.maximum.at(length, order[:-1], common)
    np.maximum.at(length, order[1:], common)
    np.maximum.at(longest, doc, length)
    at = np.flatnonzero(length >= least)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + length[at], -1)
    return np.bincount(doc[np.cumsum(depth[:-1]) > 0], minlength=texts), longest


def _duplicates(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys occur again, and which are not the first of their kind."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] = same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def measure(texts: wd.Texts, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts in COLUMNS for each text."""
    n = len(texts.offsets) - 1
    data = texts.data
    w = wd.words_of(texts, wd.VISIBLE, lower=False)
    salt = lambda doc: wd.mix(doc.astype(np.uint64) + np.uint64(1))
    n_words = np.bincount(w.doc, minlength=n)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    # lines with a word, and those equal to an earlier one
    begin, end, doc = wd.spans(texts, data != 0x0A)
    with_word = np.searchsorted(w.begin, end) > np.searchsorted(w.begin, begin)
    begin, end, doc = begin[with_word], end[with_word], doc[with_word]
    lines = wd.mix(wd.span_hash(wd.running(texts, wd.RAW_VALUES), begin, end) ^ salt(doc))
    _, later = _duplicates(lines)
    # words in three-word windows that occur twice or more
    g = wd.grams(w.hash, 3)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[2 : 2 + len(g)])
    twice, _ = _duplicates(wd.mix(g[at] ^ salt(w.doc[at])))
    repeated = np.zeros(len(w.doc), bool)
    for j in range(3):
        repeated[at[twice] + j] = True
    covered, longest = repeats(w.hash, w.doc, n, least)
    values = (
        n_words, wd.per_text(texts, wd.VISIBLE[data] & ((data & 0xC0) != 0x80)), wd.per_text(texts, symbols[data]),
        np.bincount(doc[later], minlength=n), np.bincount(w.doc[repeated], minlength=n), covered, longest,
    )
    return dict(zip(COLUMNS, (v.astype(np.int64) for v in values), strict=True))


def repetition(
    docs: DataFrame, least: int = MIN_REPEAT, most_covered: float = MOST_COVERED, most_longest: float = MOST_LONGEST
) -> DataFrame:
    """``docs`` with a struct column ``rules``: the counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule of 50 words. Equal rows have equal results; no row is
    lost or moved, so there is no shuffle. A column of ``docs`` called rules is replaced.
    """
    docs = docs.drop("rules")
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COLUMNS) + ">"
    schema = docs.withColumn("rules", F.lit(None).cast(kind)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            found = measure(wd.texts_of(batch.column("text")), least)
            rules = pa.StructArray.from_arrays([pa.array(found[c]) for c in COLUMNS], names=list(COLUMNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, rules], names=[*batch.schema.names, "rules"])

    n, r = F.col("rules.n_words"), F.col("rules")
    failed = (n < MIN_WORDS) | (100 * r["n_repeat_words"] > 50 * n)
    fine = (r["n_covered"] <= most_covered * n) & (r["longest_repeat"] <= most_longest * n)
    return docs.mapInArrow(count, schema).withColumn("rules", F.struct("rules.*", failed.alias("base_failed"), (~failed & fine).alias("kept")))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for all documents."""
    return repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*")


SQL = None  # maximal repeats need a suffix structure; tested against brute force
