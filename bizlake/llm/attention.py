"""Language-model scoring with a small causal self-attention model on subword ids.

Words become ids of a public byte-pair vocabulary (never trained here). The next id is predicted in three steps: its
class, from a table of the two ids before plus one head of masked attention; its leaf of the class, from the id before; and the id in
the leaf, by its frequency. The counts come from all training documents, whose ids are written once; the attention is
trained on all of them, each task on its own from a common start, and the parameters are averaged. Texts are scored in windows of two
blocks of which the second is scored, so every token is scored once and sees at least a block of context.

The base score needs each word's count in all training documents. Frequent words are looked up in a table of bounded
size; the others meet their counts in a join.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm import words as wd
from bizlake.llm.language import fold
from bizlake.llm.store import table, written

FOLDS, HELD_OUT = 7, 2
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARE = 1  # one in so many training documents trains the attention: all
KNOWN_IDS = 2048  # ids with an embedding of their own; the last stands for all others
CLASSES = 32  # that attention tells apart
LEAVES = 1024  # parts of the classes, predicted from the id before
SINGLE = 960  # leaves of one id
CONTEXTS = 65_536  # rows, about, of the table of the two ids before
WIDTH = 16
BLOCK = 32  # ids; each one sees 32 to 63 before it
ROUNDS = 1
RATE = 0.01
BATCH_BLOCKS = 256
STEP_BLOCKS = 256  # scored at once
HOT_WORDS = 100_000  # words, at most, whose counts every task holds
CHUNK = 2 << 20  # bytes of ids counted or trained on at once
CACHE_WORDS = 500_000
PARTS = 16
PACKS = 64  # of the counts of pairs
PRIOR = 4.0  # occurrences that the share without context counts for
CONTEXT_PRIOR = 20.0  # occurrences that the shares after one id count for in those after two


class Vocabulary(NamedTuple):
    """How subword ids (the last one is the end) fall into known ids and leaves, leaves into classes, and ids' log shares of their leaf."""

    known: np.ndarray
    leaf: np.ndarray
    within: np.ndarray
    klass: np.ndarray
    rows: np.ndarray
    row: np.ndarray


class Bigrams(NamedTuple):
    """Log probabilities of the classes, by context, and of the leaves within their class, by the known id before."""

    classes: np.ndarray
    leaves: np.ndarray


def _pieces(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}


def tokenizer(ranks: bytes) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """An encoder of words (each with a blank before it) from the text of a vocabulary file: all ids in a row, and how many each word has."""
    import tiktoken

    pieces = _pieces(ranks)
    begins = _begins(pieces)
    encoding = tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=pieces, special_tokens={})

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encoding.encode_ordinary((b" " + b" ".join(words)).lower().decode(errors="replace")), np.int32)
        return ids, np.diff(np.flatnonzero(begins[ids]), append=len(ids))

    return encode


def _begins(pieces: dict[bytes, int]) -> np.ndarray:
    """Which ids begin a word: those with a blank in front, as words have no other."""
    out = np.zeros(max(pieces.values()) + 2, bool)  # and one for the end
    out[[i for piece, i in pieces.items() if piece[:1] == b" "]] = True
    return out


class Encoder:
    """Ids of all words of a chunk; each distinct word is encoded once, as long as the cache holds it."""

    def __init__(self, ranks: bytes) -> None:
        self.encode = tokenizer(ranks)
        self.hash, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __call__(self, texts: wd.Texts, w: wd.Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        coded = pa.array(w.hash).dictionary_encode()
        distinct, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.zeros(len(distinct), np.int64)
        first[back[::-1]] = np.arange(len(back))[::-1]
        at = np.searchsorted(self.hash, distinct)
        missing = self.hash[np.minimum(at, len(self.hash) - 1)] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        if missing.any() and len(self.hash) > CACHE_WORDS:
            self.hash, self.start, self.count, self.flat = self.hash[:0], self.start[:0], self.count[:0], self.flat[:0]
            missing[:] = True
        start, count = (np.empty(len(distinct), np.int64) for _ in range(2))
        start[~missing], count[~missing] = self.start[at[~missing]], self.count[at[~missing]]
        if missing.any():
            raw = texts.data.tobytes()
            ids, count[missing] = self.encode([raw[a:b] for a, b in zip(w.begin[first[missing]].tolist(), w.end[first[missing]].tolist(), strict=True)])
            start[missing] = len(self.flat) + np.cumsum(count[missing]) - count[missing]
            self.flat = np.concatenate([self.flat, ids])
            merged = np.concatenate([self.hash, distinct[missing]])
            order = np.argsort(merged, kind="stable")
            self.hash, self.start, self.count = (
                merged[order], np.concatenate([self.start, start[missing]])[order], np.concatenate([self.count, count[missing]])[order]
            )
        start, count = start[back], count[back]
        ends = np.cumsum(count)
        return self.flat[np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)], count


def sequences(texts: wd.Texts, w: wd.Words, encoder: Encoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (with their words) in a row, each text closed by ``end``, and the text of each."""
    ids, count = encoder(texts, w)
    n = len(texts.offsets) - 1
    per = np.bincount(w.doc, count, minlength=n).astype(np.int64) if len(count) else np.zeros(n, np.int64)
    out = np.full(len(ids) + n, end, np.int32)
    doc = np.repeat(np.arange(n), per + 1)
    closing = np.cumsum(per + 1) - 1
    inside = np.ones(len(out), bool)
    inside[closing] = False
    out[inside] = ids
    return out, doc


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Known ids are the most frequent ones, as are the leaves of one id; other leaves, and the classes, have like mass.

    The contexts of a known id, told apart by the id before it, are as many as its share asks for, one at least. The start of a
    text is as frequent as its end, the last id.
    """
    order = np.argsort(-counts, kind="stable")
    known = np.full(len(counts), KNOWN_IDS - 1, np.int32)
    known[order[: KNOWN_IDS - 1]] = np.arange(KNOWN_IDS - 1)
    smooth = counts + 0.01
    leaf = np.zeros(len(counts), np.int32)
    leaf[order[:SINGLE]] = np.arange(SINGLE)
    leaf[order[SINGLE:]] = SINGLE + _by_mass(smooth[order[SINGLE:]], LEAVES - SINGLE)
    total = np.bincount(leaf, smooth, minlength=LEAVES)
    mass = np.append(np.bincount(known, counts, minlength=KNOWN_IDS), counts[-1])
    rows = np.maximum(1, np.floor(mass / max(1.0, mass.sum()) * (CONTEXTS - KNOWN_IDS - 1))).astype(np.int32)
    row = (np.cumsum(rows) - rows).astype(np.int32)
    return Vocabulary(known, leaf, np.log(smooth / np.maximum(total, 1e-9)[leaf]).astype(np.float32), _by_mass(total, CLASSES), rows, row)


def _by_mass(mass: np.ndarray, groups: int) -> np.ndarray:
    sums = np.cumsum(mass)
    return np.minimum(((sums - mass / 2) / sums[-1] * groups).astype(np.int32), groups - 1)


def bigram_tables(follow: np.ndarray, v: Vocabulary, after_two: np.ndarray | None = None) -> Bigrams:
    """From how often each leaf follows each known id, and each class each context (as far as that is known)."""
    share = follow.sum(axis=0) + 0.01
    by_class = lambda x: np.stack([x[..., v.klass == c].sum(axis=-1) for c in range(CLASSES)], axis=-1)
    class_share, class_follow = by_class(share), by_class(follow)
    class_share = np.maximum(class_share, 1e-9)
    classes = (class_follow + PRIOR * class_share / class_share.sum()) / (class_follow.sum(axis=1, keepdims=True) + PRIOR)
    leaves = (follow + PRIOR * (share / class_share[v.klass])) / (class_follow + PRIOR)[:, v.klass]
    classes = np.repeat(classes, v.rows, axis=0)
    if after_two is not None:
        classes = (after_two + CONTEXT_PRIOR * classes) / (after_two.sum(axis=1, keepdims=True) + CONTEXT_PRIOR)
    return Bigrams(np.log(classes).astype(np.float32), np.log(leaves).astype(np.float32))


SHAPES = {"embed": (KNOWN_IDS + 1, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "place": (BLOCK, 2 * BLOCK)}


def start() -> dict[str, np.ndarray]:
    """The parameters before training, the same everywhere. The output is zero, so training starts from the bigrams."""
    draw = np.random.default_rng(11)
    made = {k: draw.normal(0, 0.3, shape).astype(np.float32) for k, shape in SHAPES.items()}
    made["out"][:] = 0
    made["place"][:] = 0
    return made


_AHEAD = np.where(np.arange(2 * BLOCK) <= np.arange(BLOCK)[:, None] + BLOCK, 0, -1e4).astype(np.float32)  # no weight for later ids
_ONES = {n: np.ones(n, np.float32) for n in (2 * BLOCK, CLASSES)}
SCALE = np.float32(1 / math.sqrt(WIDTH))
PROJECTIONS = ("query", "key", "value")
LANES = 8


def _filled(x: np.ndarray, fill: int) -> np.ndarray:
    """The row, filled up to whole blocks."""
    short = -len(x) % BLOCK
    return np.concatenate([x, np.full(short, fill, x.dtype)]) if short else x


def _tables(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Query (scaled), key and value of every known id."""
    return [p["embed"] @ x for x in (p["query"] * SCALE, p["key"], p["value"])]


class Room:
    """Arrays that the steps of a pass use again, by name; fresh ones of this size cost as much as filling them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def _attend(tables: list[np.ndarray], place: np.ndarray, inputs: np.ndarray, doc: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
    """Queries, keys, values, weights, one over the sum of each id's weights, and mixed values of a row of ids that fills whole blocks.

    Keys and values are those of a block and the block before it.
    """
    n = len(inputs) // BLOCK
    rows = [room(name, BLOCK + len(inputs), WIDTH) for name in PROJECTIONS]
    for x, table in zip(rows, tables, strict=True):
        x[:BLOCK] = 0
        np.take(table, inputs, axis=0, out=x[BLOCK:], mode="clip")
    q = rows[0][BLOCK:].reshape(n, BLOCK, WIDTH)
    k2, v2 = (np.ndarray((n, 2 * BLOCK, WIDTH), np.float32, x, strides=(4 * BLOCK * WIDTH, 4 * WIDTH, 4)) for x in rows[1:])
    where = doc.reshape(-1, BLOCK)
    before = np.full_like(where, -2)
    before[1:] = where[:-1]
    weight = np.matmul(q, k2.transpose(0, 2, 1), out=room("weight", n, BLOCK, 2 * BLOCK))
    weight += place + _AHEAD
    _limit(weight, 30, _reach(*tables[:2]) + float(place.max()))
    np.exp(weight, out=weight)
    mixed = np.flatnonzero((before[:, 0] != where[:, -1]) | (where[:, 0] != where[:, -1]))  # blocks with more than one text
    weight[mixed] *= where[mixed][:, :, None] == np.concatenate([before[mixed], where[mixed]], axis=1)[:, None, :]
    share = 1 / (weight.reshape(-1, 2 * BLOCK) @ _ONES[2 * BLOCK])
    values = np.matmul(weight, v2, out=room("mixed", n, BLOCK, WIDTH)).reshape(-1, WIDTH)
    values *= share[:, None]
    return q, k2, v2, weight, share, values


def _reach(a: np.ndarray, b: np.ndarray) -> float:
    """What no product of a row of one and a row of the other exceeds."""
    return math.sqrt(np.einsum("ij,ij->i", a, a).max() * np.einsum("ij,ij->i", b, b).max())


def _limit(x: np.ndarray, most: float, reach: float) -> None:
    """No value above ``most``; nothing is to be done if none can reach it."""
    if not reach <= most:
        np.minimum(x, np.float32(most), out=x)


def _inputs(ids: np.ndarray, doc: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The id before each one; the first of a text has the start of text."""
    before = np.full(len(ids), KNOWN_IDS, np.int32)
    before[1:] = np.where(doc[1:] == doc[:-1], np.take(v.known, ids[:-1]), KNOWN_IDS)
    return before


def _contexts(before: np.ndarray, doc: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The context of each id, by the two before it."""
    second = np.full(len(before), KNOWN_IDS, np.int32)
    second[1:] = np.where(doc[1:] == doc[:-1], before[:-1], KNOWN_IDS)
    return np.take(v.row, before) + second % np.take(v.rows, before)


def log_likelihood(p: dict[str, np.ndarray], bigrams: Bigrams, v: Vocabulary, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The log probability of each id, given those before it in its text."""
    out = np.empty(len(ids), np.float64)
    step = BLOCK * STEP_BLOCKS
    before, leaf = _inputs(ids, doc, v), np.take(v.leaf, ids)
    klass, context = np.take(v.klass, leaf), _contexts(before, doc, v)
    known = np.take(bigrams.leaves.reshape(-1), before * LEAVES + leaf) + np.take(v.within, ids)
    doc, tables, room = doc.astype(np.int32), _tables(p), Room()
    reach = _reach(tables[2], p["out"].T)
    for at in range(0, len(ids), step):
        low = max(0, at - BLOCK)  # the block before is context only
        piece = slice(low, at + step)
        mixed = _attend(tables, p["place"], _filled(before[piece], 0), _filled(doc[piece], -1), room)[-1][: len(before[piece])][at - low :]
        logits = np.matmul(mixed, p["out"], out=room("logits", len(mixed), CLASSES))
        logits += np.take(bigrams.classes, context[at : at + step], axis=0, out=room("classes", len(mixed), CLASSES), mode="clip")
        _limit(logits, 60, reach)
        chosen = logits[np.arange(len(logits)), klass[at : at + step]]
        np.exp(logits, out=logits)
        out[at : at + step] = chosen - np.log(logits @ _ONES[CLASSES]) + known[at : at + step]
    return out


def train_local(p: dict[str, np.ndarray], bigrams: Bigrams, v: Vocabulary, ids: np.ndarray, doc: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass of Adam over the ids, in single precision."""
    flat = np.concatenate([p[k].ravel() for k in SHAPES])
    p, (first, second, slopes) = _named(flat), np.zeros((3, len(flat)), np.float32)
    grad = _named(slopes)
    before, klass, doc = _inputs(ids, doc, v).astype(np.uint16), np.take(v.klass, np.take(v.leaf, ids)), doc.astype(np.int32)
    context = _contexts(before, doc, v)
    size, room, turned = BLOCK * BATCH_BLOCKS, Room(), (0, 2, 1)
    for turn, at in enumerate(range(0, len(ids), size), 1):
        x, d, y = before[at : at + size], doc[at : at + size], klass[at : at + size]
        n, tables = len(x), _tables(p)
        q, k2, v2, weight, share, mixed = _attend(tables, p["place"], _filled(x, 0), _filled(d, -1), room)
        slope = np.matmul(mixed[:n], p["out"], out=room("slope", n, CLASSES))
        slope += np.take(bigrams.classes, context[at : at + size], axis=0, out=room("classes", n, CLASSES), mode="clip")
        _limit(slope, 60, _reach(tables[2], p["out"].T))
        np.exp(slope, out=slope)
        # Rows of slopes and weights are divided by their sums where they meet others of WIDTH values, which are shorter.
        sums = slope @ _ONES[CLASSES]
        slope.reshape(-1)[np.arange(0, n * CLASSES, CLASSES) + y] -= sums
        scale = np.float32(1 / n) / sums
        grad["out"][:] = np.multiply(mixed[:n], scale[:, None], out=room("scaled", n, WIDTH)).T @ slope
        back = room("back", *mixed.shape)
        np.matmul(slope, p["out"].T, out=back[:n])
        back[:n] *= (scale * share[:n])[:, None]
        back[n:] = 0
        along = np.einsum("ij,ij->i", back, mixed)
        back = back.reshape(q.shape)
        by_score = np.matmul(back, v2.transpose(turned), out=room("by_score", *weight.shape))
        by_score -= along.reshape(-1, BLOCK, 1)
        by_score *= weight
        np.sum(by_score, axis=0, out=grad["place"])
        both = room("both", len(q), 2 * BLOCK, WIDTH)
        rows = [room(f"by_{name}", len(mixed) + 1, WIDTH) for name in PROJECTIONS]
        np.matmul(by_score, k2, out=rows[0][:-1].reshape(q.shape))
        _fold_back(np.matmul(by_score.transpose(turned), q, out=both), rows[1])
        _fold_back(np.matmul(weight.transpose(turned), back, out=both), rows[2])
        seen, by = _by_id(x, rows, room)
        own, grad["embed"][:] = p["embed"][seen], 0
        for name, g, factor in zip(PROJECTIONS, by, (SCALE, 1, 1), strict=True):
            np.multiply(own.T @ g, factor, out=grad[name])
            grad["embed"][seen] += g @ p[name].T * factor
        first += np.float32(0.1) * (slopes - first)
        slopes *= slopes
        second += np.float32(0.01) * (slopes - second)
        spread = np.sqrt(second * np.float32(1 / (1 - 0.99**turn)))
        flat -= np.float32(rate / (1 - 0.9**turn)) * first / (spread + np.float32(1e-8))
    return p


def _named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters, which lie in a row."""
    ends = np.cumsum([math.prod(x) for x in SHAPES.values()])
    return {k: x.reshape(shape) for (k, shape), x in zip(SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}


def _fold_back(g: np.ndarray, out: np.ndarray) -> None:
    """Slopes by the rows of blocks with their previous ones, added up by row."""
    out = out[:-1].reshape(-1, BLOCK, WIDTH)
    np.add(g[:-1, BLOCK:], g[1:, :BLOCK], out=out[:-1])
    out[-1] = g[-1, BLOCK:]


def _by_id(x: np.ndarray, rows: list[np.ndarray], room: Room) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ids, and the sums of each array's rows by id; an array has a row more than there are, for nothing.

    The rows of an id are filled up to whole groups of ``LANES``, which are added up side by side; only the groups are added one by one.
    """
    order = np.argsort(x, kind="stable")
    sorted_ids = x[order]
    first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    count = np.diff(first, append=len(x))
    groups = (count + LANES - 1) // LANES
    begin = np.cumsum(groups) - groups
    where = np.full(int(groups.sum()) * LANES, len(rows[0]) - 1)
    where[np.arange(len(x)) + np.repeat(begin * LANES - first, count)] = order
    sums = []
    for g in rows:
        g[-1] = 0
        part = np.take(g, where, axis=0, out=room("lanes", len(where), WIDTH), mode="clip").reshape(-1, LANES, WIDTH)
        sums.append(np.add.reduceat(np.einsum("ijk->ik", part), begin, axis=0))
    return sorted_ids[first], sums


def _encoded(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the written texts, and the text of each, a chunk at a time."""
    for batch in wd.chunks(batches, "ids", CHUNK):
        yield _stored(batch, kind)


def _stored(batch: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray]:
    texts = wd.texts_of(batch.column("ids"))
    lengths = np.diff(texts.offsets) // np.dtype(kind).itemsize
    return texts.data.view(kind).astype(np.int32), np.repeat(np.arange(len(lengths)), lengths)


def _words(ids: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of each word of a row of texts; the ids of a word tell it."""
    end = len(begins) - 1
    at = np.flatnonzero(begins[ids] | (ids == end))
    word = ids[at[:-1]] != end
    values = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, len(begins), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = at[:-1][word]
    return doc[begin], wd.span_hash(wd.running(wd.Texts(ids, doc), values), begin, at[1:][word])


def _add_up(rows: pa.Table) -> pa.Table:
    """The weighted sum of parameter parts."""
    weight = rows.column("weight").to_numpy()
    total = sum(np.frombuffer(x, np.float64) * (1.0 if w < 0 else w) for x, w in zip(rows.column("values").to_pylist(), weight, strict=True))
    return pa.table({"part": rows.column("part").slice(0, 1), "total": pa.array([float(np.abs(rows.column("total").to_numpy()).sum())]), "values": pa.array([total.tobytes()], pa.binary())})


class Scorer(NamedTuple):
    """Everything that scoring a text needs."""

    ranks: bytes
    vocabulary: Vocabulary
    bigrams: Bigrams
    parameters: dict[str, np.ndarray]


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, size (bytes of the text) and ids (its subword ids, two or four bytes each) of each row, written once; null is empty.

    The ids hold all of the text that learning and scoring need: words are told by them.
    """
    with open(path, "rb") as f:
        return _encoded_by(docs, f.read())


def _encoded_by(docs: DataFrame, ranks: bytes) -> DataFrame:
    if "ids" in docs.columns:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    end, kind = _sizes(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in wd.chunks(batches):
            texts = wd.texts_of(batch.column("text"))
            ids, doc = sequences(texts, wd.words_of(texts, wd.VISIBLE), encoder, end)
            offsets = (np.searchsorted(doc, np.arange(batch.num_rows + 1)) * np.dtype(kind).itemsize).astype(np.int32)
            flat = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])
            size = pa.array(np.diff(texts.offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, flat], names=["doc_id", "size", "ids"])

    rows = docs.select("doc_id", "text")
    return written(rows.mapInArrow(encode, rows.select("doc_id").schema.simpleString()[7:-1] + ",size bigint,ids binary"), "lm-ids")


def _sizes(ranks: bytes) -> tuple[int, type]:
    """The id of the end, and the type of stored ids."""
    end = len(ranks.splitlines())
    return end, np.uint16 if end < 1 << 16 else np.int32


def learn(train: DataFrame, path: str = VOCABULARY, share: int = SHARE, rounds: int = ROUNDS) -> Scorer:
    """The model of the training documents (doc_id and text, or ``encoded``); its size is fixed.

    All of them are counted. One in ``share``, chosen by hash of doc_id, trains the attention.
    """
    spark = train.sparkSession
    with open(path, "rb") as f:
        ranks = f.read()
    end, kind = _sizes(ranks)
    train = _encoded_by(train, ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for ids, _ in _encoded(batches, kind):
            total += np.bincount(ids, minlength=end + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(end + 1, np.float64)
    for r in train.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row per id
        counts[r["id"]] = r["n"]
    v = vocabulary(counts)
    shipped = spark.sparkContext.broadcast(tuple(v))  # plain types, which workers can load without this package

    n_pairs, n_contexts = (KNOWN_IDS + 1) * LEAVES, int(v.rows.sum())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = Vocabulary(*shipped.value), np.zeros(n_pairs + n_contexts * CLASSES, np.int64)
        for ids, doc in _encoded(batches, kind):
            before, leaf = _inputs(ids, doc, v), v.leaf[ids]
            total[:n_pairs] += np.bincount(before.astype(np.int64) * LEAVES + leaf, minlength=n_pairs)
            total[n_pairs:] += np.bincount(_contexts(before, doc, v).astype(np.int64) * CLASSES + v.klass[leaf], minlength=n_contexts * CLASSES)
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.linspace(0, len(total), PACKS + 1)[1:-1])
        packs = [[x.tobytes() for x in np.split(y, cuts)] for y in (at.astype(np.int32), total[at])]
        yield pa.RecordBatch.from_arrays([pa.array(range(PACKS), pa.int32()), *(pa.array(x, pa.binary()) for x in packs)], names=["pack", "pair", "n"])

    def add_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs + n_contexts * CLASSES, np.int64)
        for batch in batches:
            for at, n in zip(batch.column("pair"), batch.column("n"), strict=True):
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)  # a pack has a pair once
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    follow = np.zeros(n_pairs + n_contexts * CLASSES, np.float64)
    counted = train.select("ids").mapInArrow(pairs, "pack int, pair binary, n binary").repartition("pack")
    found = counted.mapInArrow(add_packs, "pair int, n bigint").toArrow()  # at most one row per pair, and per context and class
    follow[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    bigrams = bigram_tables(follow[:n_pairs].reshape(-1, LEAVES), v, follow[n_pairs:].reshape(-1, CLASSES))
    taught = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("ids")
    p, given = start(), spark.sparkContext.broadcast(tuple(bigrams))
    for turn in range(rounds):
        begun = spark.sparkContext.broadcast(p)

        def fit(batches: Iterator[pa.RecordBatch], turn: int = turn, begun=begun) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            v, own, seen = Vocabulary(*shipped.value), begun.value, 0
            for ids, doc in _encoded(batches, kind):
                own, seen = train_local(own, Bigrams(*given.value), v, ids, doc, RATE / (1 + turn)), seen + len(ids)
            if seen:
                flat = np.concatenate([own[k].ravel() for k in SHAPES]).astype(np.float64)
                edges = np.linspace(0, len(flat), PARTS + 1).astype(int)
                blobs = [flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([float(seen)] * PARTS), pa.array([float(seen)] * PARTS), pa.array(blobs, pa.binary())],
                    names=["part", "weight", "total", "values"],
                )

        fitted = taught.mapInArrow(fit, "part int, weight double, total double, values binary")
        # two levels, so that no group grows with the number of workers
        some = fitted.withColumn("some", F.pmod(F.xxhash64("values"), F.lit(1024)))
        level = some.groupBy("part", "some").applyInArrow(lambda t: _add_up(t), "part int, total double, values binary")
        summed = level.withColumn("weight", F.lit(-1.0)).groupBy("part").applyInArrow(lambda t: _add_up(t), "part int, total double, values binary").collect()
        if summed:
            flat = np.concatenate([np.frombuffer(r["values"], np.float64) / r["total"] for r in sorted(summed, key=lambda r: r["part"])]).astype(np.float32)
            p = _named(flat)
    return Scorer(ranks, v, bigrams, p)


def word_counts(train: DataFrame, ranks: bytes) -> DataFrame:
    """word (hash), c: how often each word occurs in the texts."""
    (_, kind), train = _sizes(ranks), _encoded_by(train, ranks)
    shipped = train.sparkSession.sparkContext.broadcast(_begins(_pieces(ranks)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = [], 0

        def flush() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(hashes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], names=["word", "c"])

        for ids, doc in _encoded(batches, kind):
            hashes.append(_words(ids, doc, shipped.value)[1])
            held += len(hashes[-1])
            if held > 6_000_000:
                yield flush()
                hashes, held = [], 0
        if hashes:
            yield flush()

    return train.select("ids").mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Places:
    """Where hashes stand in a rising row of hashes, by their first bits."""

    def __init__(self, row: np.ndarray, bits: int = 18) -> None:
        self.shift, self.row = np.uint64(64 - bits), row
        start = np.searchsorted(row, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.start, self.most = start.astype(np.int32), int(np.diff(start, append=len(row)).max())
        self.filled = np.append(row, np.zeros(self.most, np.uint64))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, if it is found, and whether it is."""
        at, found = np.take(self.start, (h >> self.shift).astype(np.int64)), np.zeros(len(h), bool)
        low = at.copy()
        for k in range(self.most):
            same = (np.take(self.filled, low + k) == h) & (low + k < len(self.row))
            at[same] = low[same] + k
            found |= same
        return at, found


def score_texts(docs: DataFrame, train: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    Null and empty texts are the end alone. Whole texts are scored; equal texts have equal scores up to rounding. With
    no training text all words are unknown. Rows that are ``encoded`` already keep their ids; other columns are ignored.
    """
    spark = docs.sparkSession
    docs, train = _encoded_by(docs, model.ranks), _encoded_by(train, model.ranks)
    counts = written(word_counts(train, model.ranks), "word-counts")
    closed = train.count()
    whole = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, kinds = whole["n"] + closed, whole["v"] + (closed > 0)
    by_size = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).count().collect()}  # at most 64 rows
    least, total = 64, 0
    for k in sorted(by_size, reverse=True):
        if total + by_size[k] > HOT_WORDS:
            break
        least, total = k, total + by_size[k]
    hot = sorted((r["word"] & (2**64 - 1), r["c"]) for r in counts.filter(F.col("c") >= 2**least).collect()) if least < 63 else []
    tables = spark.sparkContext.broadcast((np.array([x for x, _ in hot], np.uint64), np.log10(np.array([c for _, c in hot], np.float64) + 1)))
    shipped = spark.sparkContext.broadcast((_begins(_pieces(model.ranks)), tuple(model.vocabulary), tuple(model.bigrams), model.parameters))
    end_known, end_value, (_, kind) = int(closed > 0), math.log10(closed + 1), _sizes(model.ranks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (begins, v, bigrams, parameters), (word, value) = shipped.value, tables.value
        v, bigrams, places = Vocabulary(*v), Bigrams(*bigrams), Places(word)
        for batch in wd.chunks(batches, "size"):
            size = batch.num_rows
            ids, doc = _stored(batch, kind)
            w_doc, w_hash = _words(ids, doc, begins)
            at, found = places(w_hash)
            hot_sum = np.bincount(w_doc[found], value[at[found]], minlength=size) + end_value if len(word) else np.full(size, end_value)
            tail = w_hash[~found].view(np.int64)
            offsets = np.searchsorted(w_doc[~found], np.arange(size + 1)).astype(np.int32)
            total = np.bincount(doc, log_likelihood(parameters, bigrams, v, ids, doc), minlength=size) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.bincount(w_doc, minlength=size) + 1), pa.array(np.bincount(w_doc[found], minlength=size) + end_known),
                    pa.array(hot_sum), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tail)),
                ],
                names=["doc_id", "n_tokens", "n_hot", "hot_sum", "score", "tail"],
            )

    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ",n_tokens bigint,n_hot bigint,hot_sum double,score double,tail array<bigint>"
    rows = written(docs.select("doc_id", "size", "ids").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rest = (
        rows.select("row", F.explode("tail").alias("word")).join(counts, "word")
        .groupBy("row").agg(F.count("*").alias("n_rest"), F.sum(F.log10(F.col("c") + 1)).alias("rest_sum"))
    )
    known = F.col("n_hot") + F.coalesce("n_rest", F.lit(0))
    base = F.col("hot_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + kinds + 1)))
    return rows.drop("tail").join(rest, "row", "left").select(
        "doc_id", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probabilities of all documents, learned from the folds but the third."""
    docs = encoded(table(spark, sf_dir, "documents"))
    train = docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = score_texts(docs, train, learn(train))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL = None  # a trained model; the base columns are tested against brute force
