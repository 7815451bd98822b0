"""The prefix trie against brute force: random trees, hard rows, split components, the smallest table."""

import hashlib
import random
import zlib

import pytest
from bizlake.llm import catalog, trie

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute_sums(parent, values):
    sums = [list(v) for v in values]
    for v in reversed(range(len(parent))):
        if parent[v] >= 0:
            sums[parent[v]] = [a + b for a, b in zip(sums[parent[v]], sums[v], strict=True)]
    return sums


def test_centroids_sum_every_subtree():
    rng = random.Random(5)
    for turn in range(400):
        n = rng.randrange(1, 60)
        kind = turn % 4
        parent = [-1 if i == 0 or (kind == 3 and rng.random() < 0.1) else i - 1 if kind == 0 else 0 if kind == 1 else rng.randrange(i) for i in range(n)]
        values = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        assert trie.subtree_sums(parent, values) == brute_sums(parent, values)
    chain = [i - 1 for i in range(20_000)]
    assert trie.subtree_sums(chain, [(1,)] * 20_000)[0] == [20_000]


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key in members:
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    out = set()
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.add((min(own), len(key), parent, len(own), len(children.get(key, ())), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made_rows(seed, many, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(many * 3), many):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(words) * (1 + (t > 3))) for t in range(rng.randrange(1, longest))]
    return rows


def result(spark, rows, whole=trie.WHOLE):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string").repartition(3)
    convs, turns = trie.rebuilt_turns(trie.placed_turns(frame))
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(convs, turns, whole).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("whole", [trie.WHOLE, 6])
def test_trie_equals_brute_force(spark, whole):
    rows = made_rows(1, 60, ["a", "bé", ""], 9) + [(1000 + c, t, "user", "same") for c in range(30) for t in range(40)]
    assert result(spark, rows, whole) == brute_trie(rebuilt(rows))


def test_hard_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (3, None, None, None), (3, None, "user", "x"), (3, 1, "user", "y"), (3, 1, "user", "y"), (3, 1, "assistant", "z"),
        (0, 0, "user", "a"), (100, 0, "user", "a"), (104, 0, "user", "b"), (105, 0, "user", "c"), (205, 0, None, "日本"), (207, 0, "user", "w " * 200_000), (305, 2, "user", "q"),
    ]
    convs = rebuilt(rows)
    assert any(not turns for turns in convs.values())
    assert result(spark, rows) == brute_trie(convs)
    assert result(spark, rows[:1]) == set() == result(spark, [])
    lone = [(c, 0, "user", "gone") for c in range(101, 400) if zlib.crc32(str(c).encode()) % 6 and c % 100]
    assert {r[1] for r in result(spark, lone)} == {0} and result(spark, lone) == brute_trie(rebuilt(lone))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r[c] for c in COLUMNS) for r in catalog.QUERIES["op12_prefix_trie"](spark, SF).collect()}
    assert got == brute_trie(rebuilt(rows))
