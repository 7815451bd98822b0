"""Secret scans: fixed patterns, and weak candidates that count only together.

Identifiers, credentials and endpoints are weak alone. Each is an interval of its text, widened by a reach, within a
scope (a block of lines without an empty one between). An interval join links the parts of a scope, and a weak
candidate is reported only if parts that complete it lie within reach. Scopes never leave their text, so the join runs
where the text is and nothing is shuffled.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm import words as wd
from bizlake.llm.store import table

KINDS = ("assign", "access", "hex", "identifier", "credential", "endpoint")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}
REACH = 200  # characters around a part in which others complete it
WEAK = {
    "identifier": re.compile(r"""(?<![A-Za-z])(?:user(?:name|id)?|login|account|client_?id|access_?(?:key_?)?id)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A),
    "credential": re.compile(r"""(?<![A-Za-z])(?:pwd|pass|pw|auth|private_?key|key)["']?[ ]*[:=][ ]*["']?([^\s"']{6,})""", re.I | re.A),
    "endpoint": re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![A-Za-z])(?:host|server|endpoint)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?""", re.I | re.A),
}
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}")
ENTROPY = 3.5
#: The part that each kind of hit stands for, and the parts of which one has to be near.
PART = {"assign": "credential", "access": "identifier", "hex": "credential", "identifier": "identifier", "credential": "credential", "endpoint": "endpoint"}
COMPLETES = {"identifier": ("credential",), "credential": ("identifier", "endpoint"), "endpoint": ("identifier", "credential")}
_BREAK = re.compile(r"\n[ \t]*\n")
_HEX_BYTES, _RANDOM_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_RANDOM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-"]] = True


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str, has_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if has_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def weak_spans(text: str, has_random: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the candidates that need others beside them."""
    out = []
    if ":" in text or "=" in text:
        for kind, pattern in WEAK.items():
            out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    if has_random:
        out += [(m.start(), KINDS.index("credential"), m.end()) for m in RANDOM.finditer(text) if entropy(m[0]) >= ENTROPY]
    return out


def linked(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak candidates, apart from base spans, that are completed by another part of their scope within reach."""
    weak = [w for w in set(weak) if not any(w[0] < b[2] and b[0] < w[2] for b in base)] if base else list(set(weak))
    if not weak:
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    parts: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for start, kind, end in [*base, *weak]:
        parts.setdefault((bisect.bisect_right(breaks, start), PART[KINDS[kind]]), []).append((start, end))
    longest = {k: max(b - a for a, b in v) for k, v in parts.items()}
    for v in parts.values():
        v.sort()
    out = []
    for start, kind, end in weak:
        scope, part = bisect.bisect_right(breaks, start), PART[KINDS[kind]]
        for other in COMPLETES[part]:
            own = parts.get((scope, other), ())
            # intervals that start before the widened end, and may reach the widened start
            at = bisect.bisect_left(own, (start - reach - longest.get((scope, other), 0),)) if own else 0
            while at < len(own) and own[at][0] <= end + reach and own[at][1] < start - reach:
                at += 1
            if at < len(own) and own[at][0] <= end + reach:
                out.append((start, kind, end))
                break
    return out


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans of the patterns) and spans (those and the linked ones) of each row.

    Spans are kind:start:end in code points, by start and kind, comma-joined. Null and empty texts have none; equal
    rows have equal results; other columns are ignored.
    """
    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ",n_assign bigint,n_access bigint,n_hex bigint,base string,spans string"
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            texts = wd.texts_of(batch.column("text"))
            begin, end, doc = wd.spans(texts, _HEX_BYTES[texts.data])
            long_hex = set(doc[end - begin >= LEAST["hex"]].tolist())
            begin, end, doc = wd.spans(texts, _RANDOM_BYTES[texts.data])
            long_random = set(doc[end - begin >= LEAST["random"]].tolist())  # no other text has a match of RANDOM
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base = base_spans(text or "", i in long_hex)
                more = linked(text or "", base, weak_spans(text or "", i in long_random), reach)
                rows.append((*(sum(k == j for _, k, _ in base) for j in range(3)), show(base), show(sorted(base + more))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(find, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    out = secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


SQL = None  # DuckDB's patterns give no positions; tested against brute force
