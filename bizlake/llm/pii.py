"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained by gradient ascent on the log likelihood of a small labelled table and decoded by Viterbi for many
token runs at once. Only tokens near a digit or an at sign can be labelled, so runs of other tokens are fixed as outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bizlake.llm import words as wd
from bizlake.llm.store import table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The labelled table: [kind text] marks a span.
LABELLED = (
    "please call [phone (212) 555-0147] before noon",
    "office [phone 212-555-0188] or by mail",
    "you can ring [phone 415.555.0123] any day",
    "phone: [phone (30) 5550-1234] (front desk)",
    "tel [phone 555-0199] extension 12",
    "her number is [phone +1 (743) 555-3824] today",
    "fax [phone +49 30 5550123] and post",
    "dial [phone 0044 20 7946 0958] from abroad",
    "the host [ip 10.20.30.40] answered twice",
    "traffic from [ip 192.168.7.15:8080] was high",
    "block [ip 172.16.0.1/16] at once",
    "server [ip fe80::1ff:fe23:4567:890a] is down",
    "seen at [ip 2001:db8::ff00:42:8329] again",
    "the packet to [ip 300.12.9.1] was lost",
    "write to [email ann.lee@example.com] for help",
    "contact [email sales[at]example.org] or wait",
    "mail [email bob(at)example.net] tonight",
    "from [email root@localhost] we heard",
    "ask [email j_doe+news@mail.example.co] please",
    "paid with [card 4111 1111 1111 1111] yesterday",
    "card [card 5500-0000-0000-0004] was refused",
    "charged to [card 4012888888881881] in may",
    "number [card 4111.1111.1111.1111] is stored",
    "old card [card 3782 822463 10005] expired",
    "it was the first of the month and all was well",
    "in 2024 we sold 1,299 units for 12.50 each",
    "on 2024-01-31 at 12:30 the run began",
    "see pages 10-12 and table 3.4 for more",
    "version 1.2.3 was out in 03/2021",
    "order 100200300 had 4 items",
    "isbn 978-3-16-148410-0 is out of print",
    "the id a1b2c3d4e5f60718293a4b5c6d7e8f90 is random",
    "token = 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e",
    "about 50% of 1200 people, 3 of 4 women",
    "follow @news for 24/7 updates",
    "room 12b on floor 3 costs $45.00",
    "a 16-bit cpu from the 1980s at 8 mhz",
    "score 3-2 after 90 minutes (2-1)",
    "the 3rd and the 21st of june 1999",
    "items 1. 2. 3. and 4. of the list",
    "one (two) three [four] five-six",
    "batch 0000-1111 lot 42 of 7,000,000",
)
BUCKETS = 4096
FEATURES = 6
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ACTIVE = _DIGIT.copy()
_ACTIVE[0x40] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = ord("d"), ord("U"), ord("l"), ord("l")
_EDGE = b".,;:!?\"'*$%&#|<>"


class Tokens(NamedTuple):
    """Tokens of a run of texts, the line each is in, and the ids of their features."""

    words: wd.Words
    line: np.ndarray
    active: np.ndarray
    features: np.ndarray


def tokens_of(texts: wd.Texts) -> Tokens:
    """Blank-separated tokens with their shape (classes of characters, runs taken once), length, digits and neighbours."""
    data = texts.data
    w = wd.words_of(texts, wd.VISIBLE, lower=False)
    n = len(w.begin)
    newlines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = newlines[w.begin] + w.doc  # also a new line for each text
    shape_of = _CLASS[data]
    kept = np.ones(len(data), bool)
    kept[1:] = shape_of[1:] != shape_of[:-1]
    kept[w.begin] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    kept_texts = wd.Texts(shape_of[kept], np.array([0, int(kept.sum())]))
    shape = wd.span_hash(wd.running(kept_texts, wd.RAW_VALUES), place[w.begin], place[w.end])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    digits = digits[w.end] - digits[w.begin]
    marks = np.concatenate([[0], np.cumsum(_ACTIVE[data] | (data == 0x3A) & np.roll(data == 0x3A, 1))])
    bracket_at = np.concatenate([[0], np.cumsum((data == 0x74) & np.isin(np.roll(data, -1), (0x29, 0x5D)) & np.isin(np.roll(data, 2), (0x28, 0x5B)))])
    active = (marks[w.end] - marks[w.begin] > 0) | (bracket_at[w.end] - bracket_at[w.begin] > 0)
    size = np.minimum(w.end - w.begin, 24)
    same_next = np.zeros(n, bool)
    same_next[:-1] = line[1:] == line[:-1]
    other = np.uint64(0x51ED270B)
    before, after = np.full(n, other), np.full(n, other)
    before[1:] = np.where(same_next[:-1], shape[:-1], other)
    after[:-1] = np.where(same_next[:-1], shape[1:], other)
    values = (shape, wd.mix(np.minimum(digits, 20).astype(np.uint64)), wd.mix(shape + size.astype(np.uint64)), before, after, wd.mix(before ^ wd.mix(shape)))
    features = np.empty((n, FEATURES), np.int64)
    for j, v in enumerate(values):
        features[:, j] = (wd.mix(v + np.uint64(j)) % np.uint64(BUCKETS)).astype(np.int64) + j * BUCKETS
    return Tokens(w, line, active, features)


def runs(tokens: Tokens, margin: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of the runs to be decoded: active tokens with ``margin`` tokens of the same line around them."""
    near = tokens.active.copy()
    for j in range(1, margin + 1):
        same = tokens.line[j:] == tokens.line[:-j]
        near[j:] |= tokens.active[:-j] & same
        near[:-j] |= tokens.active[j:] & same
    first = near.copy()
    first[1:] &= ~(near[:-1] & (tokens.line[1:] == tokens.line[:-1]))
    last = near.copy()
    last[:-1] &= ~(near[1:] & (tokens.line[1:] == tokens.line[:-1]))
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1 - begin


class Field(NamedTuple):
    """Weights of features by label, and of label pairs."""

    emit: np.ndarray
    move: np.ndarray


def _padded(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(length.max() if len(length) else 0)
    inside = steps < length[:, None]
    return np.where(inside, begin[:, None] + steps, 0), inside


def viterbi(field: Field, features: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The best label of each token (0 outside the runs)."""
    labels = np.zeros(len(features), np.int64)
    for some in np.array_split(np.argsort(length, kind="stable"), max(1, len(length) // 512)):
        if not len(some):
            continue
        at, inside = _padded(begin[some], length[some])
        scores = field.emit[features[at]].sum(axis=2)  # runs x steps x labels
        best, back = scores[:, 0], []
        for t in range(1, at.shape[1]):
            options = best[:, :, None] + field.move
            choice = options.argmax(axis=1)
            new = np.take_along_axis(options, choice[:, None], 1)[:, 0] + scores[:, t]
            on = inside[:, t][:, None]
            back.append(np.where(on, choice, np.arange(scores.shape[2])))
            best = np.where(on, new, best)
        state = best.argmax(axis=1)
        for t in range(at.shape[1] - 1, -1, -1):
            labels[at[inside[:, t], t]] = state[inside[:, t]]
            if t:
                state = np.take_along_axis(back[t - 1], state[:, None], 1)[:, 0]
    return labels


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(labelled: tuple[str, ...] = LABELLED, steps: int = 150, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """The field that fits the labelled lines best, by full-batch AdaGrad on the penalised log likelihood."""
    plain, marks = [], []
    for row in labelled:
        text, own = "", []
        for part in re.split(r"(\[(?:email|ip|card|phone) [^ ].*?\](?= |$|\)))", row):
            if m := re.fullmatch(r"\[(email|ip|card|phone) (.*)\]", part):
                own.append((KINDS.index(m[1]) + 1, len(text), len(text) + len(m[2])))
                text += m[2]
            else:
                text += part
        plain.append(text)
        marks.append(own)
    texts = wd.texts_of(pa.array(plain))
    tokens = tokens_of(texts)
    w = tokens.words
    gold = np.zeros(len(w.begin), np.int64)
    for i, own in enumerate(marks):
        for kind, a, b in own:
            gold[(w.doc == i) & (w.end > texts.offsets[i] + a) & (w.begin < texts.offsets[i] + b)] = kind
    edges = np.searchsorted(w.doc, np.arange(len(plain) + 1))
    at, inside = _padded(edges[:-1], np.diff(edges))
    k, (rows, steps_in) = len(KINDS) + 1, at.shape
    emit, move = np.zeros((BUCKETS * FEATURES, k)), np.zeros((k, k))
    seen_emit, seen_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    onehot = np.eye(k)[gold[at]] * inside[:, :, None]
    pairs = np.einsum("bti,btj->ij", onehot[:, :-1], onehot[:, 1:])
    for _ in range(steps):
        scores = emit[tokens.features[at]].sum(axis=2)
        forward, backward = np.zeros((rows, steps_in, k)), np.zeros((rows, steps_in, k))
        forward[:, 0] = scores[:, 0]
        for t in range(1, steps_in):
            new = _logsumexp(forward[:, t - 1][:, :, None] + move, 1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t][:, None], new, forward[:, t - 1])
        for t in range(steps_in - 2, -1, -1):
            new = _logsumexp(move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1][:, None], new, 0)
        total = _logsumexp(forward[:, -1], 1)[:, None, None]
        marginal = np.exp(forward + backward - total) * inside[:, :, None]
        joint = forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None]
        expected = (np.exp(joint) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        grad_emit = -ridge * emit
        gap = (onehot - marginal)[inside]
        for j in range(FEATURES):
            np.add.at(grad_emit, tokens.features[at[inside], j], gap)
        grad_move = pairs - expected - ridge * move
        seen_emit += grad_emit**2
        seen_move += grad_move**2
        emit += rate * grad_emit / np.sqrt(seen_emit)
        move += rate * grad_move / np.sqrt(seen_move)
    return Field(emit, move)


def _luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def _holds(kind: str, text: str) -> bool:
    """The check that a match of a base pattern has to pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "email":
        return True
    digits = re.sub(r"[^0-9]", "", text)
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and _luhn(digits)


_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
_NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start."""
    out = []
    digit = _ANY_DIGIT.search(text) is not None
    for number, kind in enumerate(KINDS):
        if _NEEDED[kind] in text and (digit or kind == "email"):
            out += [(number, *m.span()) for m in _COMPILED[kind].finditer(text) if _holds(kind, m[0])]
    return out


def added_spans(field: Field, texts: wd.Texts) -> list[list[tuple[int, int, int]]]:
    """(kind number, start, end) in code points of the spans that the field finds in each text."""
    tokens = tokens_of(texts)
    labels = viterbi(field, tokens.features, *runs(tokens))
    w, out = tokens.words, [[] for _ in range(len(texts.offsets) - 1)]
    at = np.flatnonzero(labels)
    if not len(at):
        return out
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (labels[at[1:]] != labels[at[:-1]]) | (tokens.line[at[1:]] != tokens.line[at[:-1]])
    starts = np.flatnonzero(new)
    for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
        first, last = at[a], at[b - 1]
        begin, end = int(w.begin[first]), int(w.end[last])
        raw = texts.data[begin:end].tobytes()
        begin += len(raw) - len(raw.lstrip(_EDGE))
        end -= len(raw) - len(raw.rstrip(_EDGE))
        raw = texts.data[begin:end].tobytes()
        digits = sum(0x30 <= c < 0x3A for c in raw)
        kind = int(labels[first]) - 1
        if end <= begin or not (any(x in raw for x in (b"@", b"at")) if kind == 0 else digits >= (4, 4, 12, 7)[kind] and digits <= (0, 99, 19, 15)[kind]):
            continue
        doc = int(w.doc[first])
        shift = int(points[texts.offsets[doc]])
        out[doc].append((kind, int(points[begin]) - shift, int(points[end]) - shift))
    return out


def shown(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans of the patterns) and spans (those and the field's) of each row.

    Spans are kind:start:end in code points, by kind and start, comma-joined. Spans of the field that touch a
    base span are left out. Null and empty texts have none; equal rows have equal results; other columns are ignored.
    """
    field = field or train()
    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ",n_email bigint,n_ip bigint,n_card bigint,n_phone bigint,base string,spans string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            more = added_spans(field, wd.texts_of(batch.column("text")))
            rows = []
            for text, added in zip(batch.column("text").to_pylist(), more, strict=True):
                base = base_spans(text or "")
                free = [s for s in added if not any(s[1] < b and a < s[2] for _, a, b in base)] if base else added
                counts = [sum(k == j for k, _, _ in base) for j in range(len(KINDS))]
                rows.append((*counts, shown(base), shown(sorted(base + free))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(find, schema)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    from pyspark.sql import functions as F

    out = personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


SQL = None  # DuckDB's patterns give no positions; tested against brute force
