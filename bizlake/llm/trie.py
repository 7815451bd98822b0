"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is known by its depth and an XOR of hashes of (place, turn), 128 bits, which a
running aggregate gives for all prefixes of a conversation at once; later by its smallest member and its depth.

Sums over subtrees come from splitting the forest of parent edges (the trees under the root) at centroids. With s(v) the
weight of v's subtree inside its component and W the weight of the component, the nodes with 2 s(v) > W are a path that begins at the
component's top; its last node is a centroid. The total of what lies at or below the centroid is added to each node of that path.
Then the centroid goes, and what is left above it and below each of its children are components of at most half the
weight, for which the same holds; so a chain of a million turns takes 20 rounds. Each pair of a node and one below it
is parted once, and there the one's value reaches the other.

The weight of a node is its number of members, so s(v) is known from the start: the turns that members of v have from v on.
Components that weigh more than ``whole`` are split by joins, all at once; the others are split, by the same steps, by the task that
reads them, and hold at most that many nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlake.llm.digests import joined_digests, ordered_fold
from bizlake.llm.store import table, written
from bizlake.operators.ordered import neighbours, running

WHOLE = 4096  # weight of a component that one task splits
SHARED_TURNS = 5  # turns that a rebuilt conversation takes from another at most
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes
SUMS = ("n_leaves", "saved_tokens")
NODE = ("depth", "p1", "p2")


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), b1, b2 (hashes of role and text), size (code points of the text) of all turns.

    Turns come in the order of turn, null first, then role, then the text's hashes; a null role or text is empty. Turns without a
    conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("b1"),
        F.xxhash64(F.lit(2), text, role).alias("b2"), F.char_length(text).cast("bigint").alias("size"),
    )
    return neighbours(rows, ["conv_id"], ["turn", "role", "b1", "b2"], sequence="place").select("conv_id", "place", "b1", "b2", "size")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, turns) and the turns (conv_id, depth, turns, b1, b2, size), where each conversation begins like
    the first of its hundred: with that one's first crc32(conv_id) % 6 turns, as far as it has them, in place of its own."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    counts = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    convs = counts.withColumns({"shared": shared, "first": F.col("conv_id") - F.col("conv_id") % 100})
    firsts = counts.where("conv_id % 100 = 0").select(F.col("conv_id").alias("first"), F.col("own").alias("there"))
    convs = convs.join(firsts, "first", "left").withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0)))
    heads = placed.where((F.col("place") <= SHARED_TURNS) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "first")
    begun = convs.join(heads, "first").where("place <= shared").select("conv_id", F.col("place").alias("depth"), "turns", "b1", "b2", "size")
    rest = placed.join(convs.select("conv_id", "shared", "taken", "turns"), "conv_id").where("place > shared")
    rest = rest.select("conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "turns", "b1", "b2", "size")
    return convs.select("conv_id", "turns"), begun.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn the node that it ends (p1, p2), the node before (q1, q2) and the tree's top (t1, t2)."""
    x1, x2 = (F.xxhash64(F.lit(k), "depth", "b1", "b2") for k in (1, 2))
    rows = turns.select("conv_id", "depth", "turns", "size", x1.alias("x1"), x2.alias("x2"))
    kinds = {"p1": ("bit_xor", "x1"), "p2": ("bit_xor", "x2"), "_top": ("min", F.struct("depth", "x1", "x2"))}
    found = running(rows, ["conv_id"], ["depth"], kinds)
    before = {f"q{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}
    return found.withColumns(before).select("conv_id", "depth", "turns", "size", "p1", "p2", "q1", "q2", F.col("_top.x1").alias("t1"), F.col("_top.x2").alias("t2"))


def trie_nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node: NODE, t1, t2, conv_id, parent_conv_id, n_convs, n_children, size, s (weight of its subtree), ends_sha256."""
    one = F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first("size").alias("size")
    members = F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    below = rows.groupBy(*NODE).agg(*members, *one, F.sum(F.col("turns") - F.col("depth") + 1).alias("s"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "t1", "t2", "size")]
    # an empty table has no root either
    root = convs.agg(*members, F.sum("turns").alias("s")).where("n_convs > 0").select(*zero, "conv_id", "n_convs", (F.col("s") + F.col("n_convs")).alias("s"))
    nodes = below.unionByName(root)
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    last = rows.where("depth = turns").select(*NODE, "conv_id")
    empty = convs.where("turns = 0").select(*zero[:3], "conv_id")
    # a hot node's members are joined in pieces of 4,096 ids by many tasks; the digest then reads the pieces
    pieces = last.unionByName(empty).groupBy(*NODE, F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    digests = joined_digests(pieces, NODE, ["piece"], "ids", "ends_sha256", b",")
    nodes = nodes.join(parents, ["depth", "q1", "q2"], "left").join(children, list(NODE), "left").join(digests, list(NODE), "left")
    return nodes.drop("q1", "q2").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST))})


class _Tree:
    """A component as its task reads it: nodes in the order of their depth."""

    def __init__(self) -> None:
        self.names: list[tuple] = []
        self.parents: list[tuple] = []
        self.values: list[tuple] = []

    def take(self, conv_id: int, depth: int, parent: int, *values: int) -> None:
        self.names.append((conv_id, depth))
        self.parents.append((parent, depth - 1))
        self.values.append(values)

    def sums(self) -> list[tuple]:
        place = {name: i for i, name in enumerate(self.names)}
        parent = [place.get(p, -1) for p in self.parents]
        return [(*name, *total) for name, total in zip(self.names, subtree_sums(parent, self.values), strict=True)]


def subtree_sums(parent: list[int], values: list[tuple]) -> list[list[int]]:
    """For each node of a forest the sums of the values at and below it, by centroid decomposition.

    ``parent`` is the number of each node's parent, a smaller one, or -1.
    """
    n = len(parent)
    sums = [[0] * len(v) for v in values]
    weight = [1] * n
    for v in reversed(range(n)):
        if parent[v] >= 0:
            weight[parent[v]] += weight[v]
    piece = list(range(n))  # while a component is split: the top of the part that a node falls to
    trees: dict[int, list[int]] = {}
    for v in range(n):
        piece[v] = v if parent[v] < 0 else piece[parent[v]]
        trees.setdefault(piece[v], []).append(v)
    components = list(trees.values())
    while components:
        nodes = components.pop()
        top, all_weight = nodes[0], weight[nodes[0]]
        path = [v for v in nodes if 2 * weight[v] > all_weight]
        centroid = path[-1]
        inside = {top: top}
        inside[centroid] = centroid
        for v in nodes:
            if v != top and v != centroid:
                above = inside[parent[v]]
                inside[v] = v if parent[v] == centroid else above
        parts: dict[int, list[int]] = {}
        total = list(values[centroid])
        for v in nodes:
            part = inside[v]
            if v == centroid:
                continue
            parts.setdefault(part, []).append(v)
            if top == centroid or part != top:
                for k, x in enumerate(values[v]):
                    total[k] += x
        for v in path:
            for k, x in enumerate(total):
                sums[v][k] += x
            if v != centroid:
                weight[v] -= weight[centroid]
        components += parts.values()
    return sums


def _split(state: DataFrame, paths: DataFrame, whole: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """What the components of ``state`` that weigh more than ``whole`` add to their paths, and the lighter ones they fall into.

    state: c1, c2 (the component), conv_id, depth, parent_conv_id, s, SUMS. paths: for each conversation of ``state`` and depth, the
    node there and its parent.
    """
    added, light = [], []
    on = ["c1", "c2"]
    while True:
        tops = state.groupBy(*on).agg(F.max("s").alias("w"))
        known = written(state.join(tops, on), "trie")
        light.append(known.where(F.col("w") <= whole).drop("w"))
        heavy = known.where(F.col("w") > whole)
        if not heavy.limit(1).count():
            return added, light
        path = heavy.where("2 * s > w")
        centroids = path.groupBy(*on).agg(F.min(F.struct("s", F.col("conv_id").alias("conv"), F.col("depth").alias("at"))).alias("g"))
        named = heavy.join(centroids.select(*on, "g.*").withColumnRenamed("s", "gs"), on)
        own = (F.col("conv_id") == F.col("conv")) & (F.col("depth") == F.col("at"))
        ahead = paths.select(F.col("member").alias("conv_id"), (F.col("depth") - 1).alias("at"), F.col("node").alias("child"), F.col("parent").alias("above"))
        # the child of the centroid that a node lies under, if it does
        found = named.join(ahead, ["conv_id", "at"], "left").withColumn("child", F.when((F.col("depth") > F.col("at")) & (F.col("above") == F.col("conv")), F.col("child")))
        found = written(found.withColumn("own", own).drop("above"), "trie")
        below = found.where(F.col("own") | F.col("child").isNotNull())
        totals = below.groupBy(*on).agg(*[F.sum(c).alias(c) for c in SUMS])
        added.append(path.select(*on, "conv_id", "depth").join(totals, on).select("conv_id", "depth", *SUMS))
        left = found.where(~F.col("own"))
        under = F.col("child").isNotNull()
        state = left.select(
            F.when(under, F.col("child")).otherwise(F.col("c1")).alias("c1"), F.when(under, F.col("at") + 1).otherwise(F.col("c2")).alias("c2"),
            "conv_id", "depth", "parent_conv_id", F.when(~under & (2 * F.col("s") > F.col("w")), F.col("s") - F.col("gs")).otherwise(F.col("s")).alias("s"), *SUMS,
        )


def rolled_up(nodes: DataFrame, rows: DataFrame, whole: int = WHOLE) -> DataFrame:
    """conv_id, depth and the SUMS over the subtree of each node below the root. Components of a tree share its task only up to ``whole``."""
    saved = (F.col("n_convs") - 1) * F.col("size")
    # all members of a childless node end there
    valued = nodes.where("depth > 0").select(
        "t1", "t2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "s", (F.col("s") == F.col("n_convs")).cast("bigint").alias("n_leaves"), saved.alias("saved_tokens")
    )
    tops = valued.where((F.col("depth") == 1) & (F.col("s") > whole)).select("t1", "t2", F.col("conv_id").alias("c1"), F.col("depth").alias("c2"))
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS]
    calm = valued.join(tops, ["t1", "t2"], "left_anti").select(F.lit(False).alias("split"), F.col("t1").alias("c1"), F.col("t2").alias("c2"), *columns)
    added: list[DataFrame] = []
    if tops.limit(1).count():
        hot = valued.join(tops, ["t1", "t2"])
        named = hot.select(*NODE, F.col("conv_id").alias("node"), F.col("parent_conv_id").alias("parent"))
        members = rows.join(tops.select("t1", "t2"), ["t1", "t2"]).select(F.col("conv_id").alias("member"), *NODE)
        paths = written(members.join(hot.select(F.col("conv_id").alias("member")).distinct(), "member", "left_semi").join(named, list(NODE)).select("member", "depth", "node", "parent"), "paths")
        added, light = _split(hot.select("c1", "c2", "s", *columns), paths, whole)
        for part in light:
            calm = calm.unionByName(part.select(F.lit(True).alias("split"), "c1", "c2", *columns))
    result = "conv_id bigint, depth bigint, n_leaves bigint, saved_tokens bigint"
    sums = ordered_fold(calm.withColumnsRenamed({"conv_id": "node", "depth": "at"}), ["split", "c1", "c2"], ["at"], ["node", "at", "parent_conv_id", *SUMS], result, _Tree, _Tree.take, _Tree.sums)
    sums = sums.select("conv_id", "depth", *SUMS)
    for part in added:
        sums = sums.unionByName(part)
    return sums.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in SUMS])


def prefix_trie(convs: DataFrame, turns: DataFrame, whole: int = WHOLE) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, depth from 1, turns, b1, b2, size) of ``convs`` (conv_id, turns).

    Per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (code points
    that members after the first would repeat, over the subtree), ends_sha256 (the members that end here). Conversations without
    turns are members of the root only; no conversations, no nodes. A hot first turn, or one conversation with a third of all
    turns, is split like any other component.
    """
    rows = written(prefixes(turns), "prefixes")
    nodes = written(trie_nodes(convs, rows), "nodes")
    sums = written(rolled_up(nodes, rows, whole), "sums")
    # the root's sums are those of all trees; a trie of the root alone is a leaf
    tops = nodes.where("depth = 1").select("conv_id", "depth").join(sums, ["conv_id", "depth"]).select(F.lit(None).cast("bigint").alias("conv_id"), *SUMS)
    alone = nodes.where("depth = 0").select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in SUMS])
    root = alone.unionByName(tops).agg(F.max("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS]).where(F.col("conv_id").isNotNull())
    root = root.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    done = nodes.join(sums.unionByName(root), ["conv_id", "depth"])
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    placed = written(placed_turns(table(spark, sf_dir, "conversations")), "placed")
    convs, turns = rebuilt_turns(placed)
    return prefix_trie(written(convs, "convs"), turns)


# CRC-32 of a decimal number's text, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295)"""
SQL = f"""WITH RECURSIVE given AS MATERIALIZED (
    SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, length(coalesce(text, '')) AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (
    SELECT conv_id, s, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id, cast(conv_id AS varchar) AS s FROM given)),
turns AS (
    SELECT c.conv_id, 0 AS part, g.place, g.t, g.size FROM convs c JOIN given g ON g.conv_id = c.base AND g.place <= c.h
    UNION ALL SELECT c.conv_id, 1, g.place, g.t, g.size FROM convs c JOIN given g ON g.conv_id = c.conv_id AND g.place > c.h),
deep AS (SELECT conv_id, t, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM turns),
keyed AS MATERIALIZED (
    SELECT conv_id, depth, size, md5(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k,
        depth = count(*) OVER (PARTITION BY conv_id) AS ends FROM deep
    UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM convs),
node AS MATERIALIZED (
    SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::varchar END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM keyed GROUP BY depth, k),
edge AS MATERIALIZED (
    SELECT u.depth, u.k, p.k AS pk FROM node u JOIN keyed p ON p.conv_id = u.conv_id AND p.depth = u.depth - 1),
child AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n FROM edge GROUP BY 1, 2),
valued AS MATERIALIZED (SELECT node.*, coalesce(child.n, 0) AS n_children, (node.n - 1) * size AS saved FROM node LEFT JOIN child USING (depth, k)),
sums AS (
    SELECT a.depth, a.k, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum(u.saved) AS saved
    FROM valued u JOIN keyed a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY 1, 2)
SELECT v.conv_id, cast(v.depth AS bigint) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, sums.n_leaves,
    cast(sums.saved AS bigint) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums USING (depth, k) LEFT JOIN edge e ON e.depth = v.depth AND e.k = v.k LEFT JOIN node p ON p.depth = e.depth - 1 AND p.k = e.pk"""
