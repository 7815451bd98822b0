"""Language ID by compression: a text belongs to the language whose text helps most to compress it.

Each language has a Zstandard raw-content dictionary of its training text. A text is encoded in blocks with every
dictionary; the smallest total wins, and a narrow margin is marked as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm import words as wd
from bizlake.llm.store import table

FOLDS = 5
DICTIONARY_BYTES = 32 << 10  # of each language
SAMPLE_DOCS = 400  # distinct texts of a language that its dictionary is drawn from, about
LEVEL = 9
BLOCK_BYTES = 1 << 10
MARGIN = 0.01  # of the smallest size, below which the answer counts as rejected
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def learn(docs: DataFrame, size: int = DICTIONARY_BYTES, sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A dictionary of at most ``size`` bytes for each lang of ``docs`` (text, lang).

    About ``sample`` distinct texts of each language, those of the smallest hashes (all, if there are fewer), give a piece
    each from a place chosen by hash, so about ``size`` characters of a language reach the driver. Copies count once. The most frequent language comes first.
    """
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    distinct = docs.groupBy("lang", F.xxhash64("text").alias("h")).count()
    counts = {r["lang"]: (r["n"], r["kinds"]) for r in distinct.groupBy("lang").agg(F.sum("count").alias("n"), F.count("*").alias("kinds")).collect()}  # one row per language
    if not counts:
        return {}
    by_lang = lambda value: F.create_map(*[F.lit(x) for lang, (_, kinds) in counts.items() for x in (lang, value(kinds))])[F.col("lang")]
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen = docs.filter(part < by_lang(lambda kinds: min(1 << 30, math.ceil((1 << 30) * sample / kinds))))
    # a piece somewhere in the text, the same in all copies
    share = by_lang(lambda kinds: math.ceil(size / min(sample, kinds)))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.char_length("text") - share + 1, F.lit(1))).cast("int")
    pieces = chosen.select("lang", part.alias("part"), F.substr("text", place + 1, share).alias("text")).distinct()
    rows = pieces.collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x][0], x)):
        own = [r["text"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["part"], r["text"]))]
        most = math.ceil(size / min(sample, counts[lang][1]))
        taken = b""
        for text in own:
            if len(taken) >= size:
                break
            taken = text.lower().encode()[:most].decode(errors="ignore").encode() + b"\n" + taken
        out[lang] = taken[-size:]
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, block: int = BLOCK_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score, bytes (the smallest size) and rejected for each row of ``docs`` (doc_id, text).

    The score is the share of the winner if each byte saved per block counts as evidence; ties go to the
    language with more training text. Null texts and texts without a letter are ``und`` with score 0, as are all if nothing was learned. Whole texts are
    encoded. Equal rows have equal results; other columns are ignored.
    """
    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ",lang_pred string,score double,bytes bigint,rejected boolean"
    names = list(dictionaries)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang in names:
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in wd.chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                if not coders or not text or not _LETTER.search(text):
                    rows.append((UNKNOWN, 0.0, 0, True))
                    continue
                raw = text.lower().encode()
                blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
                least = min(sizes)
                at = sizes.index(least)
                others = sizes[:at] + sizes[at + 1 :]
                gap = (min(others) - least) / least if others else 1.0
                weight = sum(math.exp((least - s) / (4 * math.sqrt(len(blocks)))) for s in sizes)
                rows.append((names[at], 1 / weight, least, gap < margin))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "lang_pred", "score", "bytes", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the folds but the first."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.filter(fold(F.col("doc_id"), FOLDS) != 0)))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score", "rejected")


SQL = None  # a trained compressor; tested by held-out accuracy
