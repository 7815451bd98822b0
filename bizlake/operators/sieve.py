"""Rows that cannot belong to a set of keys are dropped before they are shuffled.

A semi join between two large tables sends all rows of both to the tasks that compare them, and rows that are grouped first are
sent twice. The sieve notes the hash of every wanted key as one bit of a fixed number of bits and broadcasts those, so what is
broadcast does not grow with the data. A row whose bit is not set has no partner and is dropped where it is read; few others are
let through, and no wanted row is lost. The exact join stays behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 2^28 bits are 32 MB; 80 million keys set a quarter of them.
BITS = 28
WORDS = 64


def _place(key: Column, bits: int) -> tuple[Column, Column, Column]:
    """Where a key is noted: the row of ``WORDS`` words, the word in it and the bit in that."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return F.shiftright(h, 12), F.shiftright(h, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def sieve(rows: DataFrame, ids: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``rows`` without those without a ``key`` and most of those whose ``key`` is not among ``ids``; all others stay.

    Equal keys of different types have different hashes; there, and for types that are no identifiers, all ``rows`` are given back.
    """
    kind = rows.schema[key].dataType
    if kind != ids.schema[key].dataType or kind not in (T.LongType(), T.IntegerType(), T.StringType()):
        return rows
    row, word, bit = _place(F.col(key), bits)
    at = ids.where(F.col(key).isNotNull()).select(row.alias("_sieve_row"), word.alias("_sieve_word"), bit.alias("_sieve_bit"))
    noted = at.groupBy("_sieve_row").pivot("_sieve_word", [*range(WORDS)]).agg(F.expr("bit_or(shiftleft(1L, _sieve_bit))"))
    words = F.array(*[F.coalesce(F.col(str(i)), F.lit(0).cast("bigint")) for i in range(WORDS)])
    noted = F.broadcast(noted.select("_sieve_row", words.alias("_sieve_words")))
    # As a predicate, not as a join, it moves below projections and groupings by the key, to where the rows are read.
    row, word, bit = _place(F.col(key).outer(), bits)
    hit = F.getbit(F.get("_sieve_words", word), bit) == 1
    return rows.where(F.col(key).isNotNull() & noted.where((F.col("_sieve_row") == row) & hit).exists())
