"""Periodic runs of words, found online by catchers over completed dyadic blocks.

At level k a text is cut into blocks of 2**k words. Once a block is complete, its catcher watches the words that follow: each
appended word ends a suffix of 2**k words, and the one catcher whose block begins 2**k to 2**(k+1) - 1 words before that suffix
compares the two. A match is a piece of a square whose period is that distance. Matches of neighbouring blocks at one
distance join into chains, and a chain grows by less than a block at each end to the whole run.

A run of period q has at least 4q words, so its matching words (w[i] = w[i + q]) are a stretch of at least 3q; with
2**k <= q < 2**(k+1) that stretch holds at least two whole blocks, so level k finds it. All catchers of a level and all
words of a batch of texts are advanced at once, in order of the levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm import words as wd
from bizlake.llm.store import table

LEAST_LENGTH = 6  # words of a run
LEAST_PERIODS = 4  # periods in a run

Run = tuple[int, int, int]  # start, length, period


def found_runs(ids: np.ndarray, offsets: np.ndarray) -> list[list[Run]]:
    """The runs of each text, by start and period; text t is the word ids ``ids[offsets[t]:offsets[t + 1]]``."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(offsets) - 1)]
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(wd.mix(ids.astype(np.uint64) + np.uint64(1)) * wd.powers(len(ids)), out=sums[1:])
    backward = wd.powers(len(ids) + 1, True)

    def hashes(at: np.ndarray, size: int) -> np.ndarray:
        return (sums[at + size] - sums[at]) * backward[at]

    lengths = np.diff(offsets)
    size = 1
    while True:
        size_texts = np.flatnonzero(lengths >= max(LEAST_LENGTH, LEAST_PERIODS * size))
        if not len(size_texts):
            break
        for text, start, end, period in _level(ids, hashes, offsets[size_texts], offsets[size_texts + 1], size_texts, size):
            # equal stretches of several periods have the smallest
            have = found[text].get((start, end))
            if have is None or period < have:
                found[text][start, end] = period
        size *= 2
    return [sorted(((s, e - s, q) for (s, e), q in each.items()), key=lambda r: (r[0], r[2])) for each in found]


def _level(ids, hashes, starts, ends, texts, size) -> Iterator[tuple[int, int, int, int]]:
    """text, start, end, period of the runs that the catchers over blocks of ``size`` words report."""
    # every suffix of ``size`` words that begins a block or more after its text, and the block that watches it
    room = ends - starts - 2 * size + 1
    which = np.repeat(np.arange(len(starts)), room)
    place = np.arange(len(which)) - np.repeat(np.cumsum(room) - room, room) + size
    block = (place - size) // size * size
    base = starts[which]
    hit = np.flatnonzero(hashes(base + place, size) == hashes(base + block, size))
    if not len(hit):
        return
    which, block, period = which[hit], block[hit], (place - block)[hit]
    order = np.lexsort((block, period, which))
    which, block, period = which[order], block[order], period[order]
    joins = (which[1:] == which[:-1]) & (period[1:] == period[:-1]) & (block[1:] == block[:-1] + size)
    first = np.flatnonzero(np.concatenate(([True], ~joins)))
    count = np.diff(np.append(first, len(which)))
    which, block, period = which[first], block[first], period[first]
    # a chain grows by less than a block at each end
    enough = np.maximum(LEAST_LENGTH, LEAST_PERIODS * period) - period
    able = np.flatnonzero((count + 2) * size - 2 >= enough)
    which, left, period, enough = which[able], block[able], period[able], enough[able]
    right = left + count[able] * size
    base, top = starts[which], ends[which]
    step = size // 2
    while step:
        fits = left >= step
        at = base + np.where(fits, left - step, 0)
        same = fits & (hashes(at, step) == hashes(np.where(fits, at + period, at), step))
        left = left - step * same
        fits = base + right + period + step <= top
        at = base + np.where(fits, right, 0)
        same = fits & (hashes(at, step) == hashes(np.where(fits, at + period, at), step))
        right = right + step * same
        step //= 2
    for k in np.flatnonzero(right - left >= enough):
        low, high, q, b = int(left[k]), int(right[k]), int(period[k]), int(base[k])
        # the words themselves decide, not their hashes
        if np.array_equal(ids[b + low : b + high], ids[b + low + q : b + high + q]):
            yield int(texts[which[k]]), low, high + q, q


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(dropped[:-1]), strict=True) if n == 0]


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (text) for ``docs`` (doc_id, text).

    Words are runs of characters other than blanks and \\t \\n \\v \\f \\r. ``rewrite`` may replace a document's words (bytes)
    first. ``collapsed`` is the words outside the repetitions, joined by one blank. Null and empty texts have no words
    and no runs. There is one result per row, also for equal rows and null ids; other columns are left out. Rows are not moved; a task
    holds half a MB of texts, or one longer text with a few numbers per word. No rows give none.
    """

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            names = batch.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            if rewrite is not None:
                texts = [rewrite(name, words) for name, words in zip(names, texts, strict=True)]
            known: dict[bytes, int] = {}
            offsets = np.cumsum([0, *map(len, texts)])
            ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, int(offsets[-1]))
            runs = found_runs(ids, offsets)
            kept = [b" ".join(collapsed(words, r)) for words, r in zip(texts, runs, strict=True)]
            flat = [r for each in runs for r in each]
            parts = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), parts)
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(detect, schema)


def tiled(doc_id: int | None, words: list) -> list:
    """The words with a repeated tail, for one document in ten; a null id has none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, of which one in ten has a repeated tail."""
    found = periodic_runs(table(spark, sf_dir, "documents"), tiled)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.concat_ws("\n", lines), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.q")
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * b.length) div (-b.q)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


SQL = None  # maximal runs over all periods need word-by-word comparison; tested against brute force
