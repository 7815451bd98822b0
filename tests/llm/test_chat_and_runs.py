"""Chat formatting by exact round trip, periodic runs against brute force, on small fixtures and the smallest tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from bizlake.llm import catalog, chat, runs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TURN]", "[/TURN]", "\\", "[", "<", "/", "INST]", "s>", "x", " ", "\n", "é", "日"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def test_every_turn_reads_back():
    rng = random.Random(1)
    said = ["", "plain", "</s>[INST] ok [/INST]", "[\\INST]", "<\\\\<SYS>>", *("".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(4000))]
    turns = [(rng.choice(["user", "assistant", "system", "", "tool", rng.choice(said)]), text) for text in said]
    made = [chat.rendered(*t) for t in turns]
    whole = "".join(m[0] for m in made)
    back = chat.parsed(whole)
    assert [(b.role, b.text) for b in back] == turns
    assert all(chat.unescaped(data[a:b]) == text for (data, a, b), (_, text) in zip(made, turns, strict=True))
    assert all(data[a:b] == text for (data, a, b), (_, text) in zip(made, turns, strict=True) if not any(c in text for c in "[<"))


@pytest.mark.parametrize("text", ["x", "[INST]", "[INST]a", "[INST]a</s>", "[INST]a[/INST]b", "[ROLE]a[/TURN]", "[/INST]a", "[ROLE]a[TURN]b", "<s>[INST]</s>"])
def test_the_parser_rejects(text):
    assert chat.parsed(text) is None


def expected_chat(rows):
    convs = {}
    for conv, turn, role, text in rows:
        segment = chat.rendered(role or "", text or "")[0]
        convs.setdefault(conv, []).append(((turn is not None, turn or 0), segment, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), sha(learned), sum(len(s) for _, s, _, _ in turns))
    return out


def test_hard_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a [INST] b"), (1, 1, "assistant", "a [INST] b"), (1, 1, "assistant", "Z"), (1, None, None, None), (2, 0, "user", ""),
        (None, 1, "assistant", None), (None, 0, "a\n[TURN]", "日本\n</s>"), (3, 5, "assistant", "w " * 300_000), (3, 2, "system", "<<SYS>>"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string, loss_begin int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(chat.formatted(frame)).collect()}
    assert got == expected_chat(rows)
    assert chat.read_back(chat.formatted(frame.limit(0))).count() == 0


def test_query_reads_back_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r["conv_id"]: tuple(r)[1:] for r in catalog.QUERIES["op11_chat_format"](spark, SF).collect()} == expected_chat(rows)


# 13


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made_texts(rng, many):
    for _ in range(many):
        words = []
        for _ in range(rng.randrange(6)):
            piece = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            words += piece * rng.randrange(1, 9) + piece[: rng.randrange(len(piece) + 1)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]
        yield words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    texts = [*made_texts(rng, 1500), [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, ["a", "b"] * 200, list("abaab" * 40), [str(i % 37) for i in range(400)]]
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    offsets = np.cumsum([0, *map(len, texts)])
    got = runs.found_runs(ids, offsets)
    assert got == [brute_runs(t) for t in texts] and sum(map(len, got)) > 1000


def expected_runs(name, text, tile):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(name).encode()) if name is not None else 1
    if tile and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words, brute_runs(words)


def kept_words(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def test_hard_rows(spark, hard, empty):
    extra = spark.createDataFrame([(20, "x y " * 9 + "end"), (20, "x y " * 9 + "end"), (21, "a\x0ba\x0ca\ta\na\ra"), (22, "a a a a " * 8)], "doc_id bigint, text string")
    rows = hard.select("doc_id", "text", F.lit(1).alias("runs"), F.lit(2).alias("collapsed")).unionByName(extra, allowMissingColumns=True)
    short = [(r["doc_id"], r["text"]) for r in rows.collect() if len(r["text"] or "") < 10_000]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(rows).collect()]
    assert len(got) == rows.count()
    want = [(n, len(w), f, " ".join(kept_words(w, f))) for n, (w, f) in ((n, expected_runs(n, t, False)) for n, t in short)]
    assert sorted(map(str, want)) == sorted(str(g) for g in got if g[1] < 10_000)
    assert any(g[2] for g in got) and runs.periodic_runs(empty).count() == 0


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in catalog.QUERIES["op13_periodic_runs"](spark, SF).collect():
        if len(texts[r["doc_id"]] or "") > 30_000:
            continue
        words, found = expected_runs(r["doc_id"], texts[r["doc_id"]], True)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        exponent = None if best[1] is None else 1000 * best[1] // best[2]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *best, exponent)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == sha(" ".join(kept_words(words, found)))
        seen += bool(found)
    assert seen > 3
