"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word's hash is a polynomial over its (lower-cased or raw) bytes modulo 2**64, taken from one running sum, and then
mixed. Equal words have equal hashes everywhere; different words collide with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
CHUNK_BYTES = 512 << 10

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of bytes that are neither a space nor one of \t \n \v \f \r.
VISIBLE = ~SPACES
#: Words are runs of ASCII letters and digits and of everything outside ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_values(lower: bool) -> np.ndarray:
    value = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        value[0x41:0x5B] = value[0x61:0x7B]
    return value


RAW_VALUES, LOWER_VALUES = _byte_values(False), _byte_values(True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = pow(BASE, -1, 1 << 64) if inverse else BASE
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _POWERS[inverse] = np.cumprod(steps)
    return have[:n]


class Texts(NamedTuple):
    """The bytes of a run of texts; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """For each word: first byte, byte after the last, number of its text, hash."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (or by a column of sizes); a longer text has one to itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(column)
        size = pc.fill_null(lengths if pa.types.is_integer(lengths.type) else pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return Texts(raw, offsets - low)


def running(texts: Texts, values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(texts.data) + 1, np.uint64)
    np.cumsum(values[texts.data] * powers(len(texts.data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the spans of bytes from begin up to end."""
    return mix((sums[end] - sums[begin]) * powers(len(sums), True)[begin])


def spans(texts: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text number of each run of bytes that are ``inside``; runs end with their text."""
    n = len(texts.data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = texts.offsets[:-1][texts.offsets[:-1] < n]
    first[starts] = inside[starts]
    stops = texts.offsets[1:][texts.offsets[1:] > 0] - 1
    last[stops] = inside[stops]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(texts.offsets, begin, "right") - 1


def words_of(texts: Texts, table: np.ndarray, lower: bool = True) -> Words:
    """The words of the texts: runs of the bytes in ``table``, hashed without regard to ASCII case if ``lower``."""
    begin, end, doc = spans(texts, table[texts.data])
    return Words(begin, end, doc, span_hash(running(texts, LOWER_VALUES if lower else RAW_VALUES), begin, end))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, rising; sorting is faster here than numpy's hashing."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return x[first]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes (also of those that reach into the next text)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j : j + n]
    return mix(out)


def per_text(texts: Texts, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[texts.offsets])
