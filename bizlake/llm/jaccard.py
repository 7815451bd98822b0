"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.75 or more, as connected classes.

1. Sharing. A document that links has at most a quarter of its shingles to itself. The shingles below a hash threshold
   are counted over all documents, packed by hash bucket, and a document with too many of its own among them
   is out. That removes nearly all documents that are alone, exactly. It is done on all documents, then on one text of each.
2. Prefixes under several orders. Two sets that link share a token among the first quarter of each under any one order of
   all tokens. Candidates come from the order by rising frequency; those that do not also share prefix tokens under two
   hash orders are dropped; the rest are compared as whole sets.
3. Classes. Candidates are first compared with the first member of each prefix token's list, so that a group of copies is
   linked by a star, not by all pairs. What is then still in different classes and shares a prefix token is compared pair by pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlake.llm import words as wd
from bizlake.llm.graph import components, merged_components
from bizlake.llm.store import table, written

SHINGLE = 5
PERCENT = 75
SAMPLED = 0.4  # of the hash range, in step 1
BUCKET_KEYS = 1 << 20  # packed keys of a bucket, about
LEAST_BUCKETS = 256
FLUSH_KEYS, FLUSH_DOCS = 1 << 20, 60_000
FEW_NODES = 16  # a class of more nodes is compared in blocks
BLOCK_NODES = 256  # nodes of a block
MANY = 0xFFFF  # in place of a document's number: several of the same pack
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # multipliers of the hash orders


def shingles(texts: wd.Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, wd.Words]:
    """Hash and text of the distinct shingles of each text, by hash; a text of fewer words is one shingle."""
    w = wd.words_of(texts, wd.VISIBLE)
    n = len(texts.offsets) - 1
    g = wd.grams(w.hash, k)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[k - 1 : k - 1 + len(g)])
    token, doc = g[at], w.doc[at]
    count = np.bincount(w.doc, minlength=n)
    edges = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            on = count[short] > j
            whole[on] = whole[on] * np.uint64(wd.BASE) + w.hash[edges[short[on]] + j]
        token = np.concatenate([token, wd.mix(whole + count[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    return token[new], doc[new], w


def _packs(docs: DataFrame, keys: list[str], buckets: int, k: int, percent: int) -> DataFrame:
    """One row per pack of documents: their keys, digests and counts, and the sampled shingles by bucket."""
    named = docs.select(*keys).schema.simpleString()[7:-1]
    schema = (
        f"pack binary, docs array<struct<{named},digest:binary,n_shingles:bigint,n_own:int,n_shared:int>>,"
        "blobs array<struct<bucket:int,tokens:binary,owners:binary>>"
    )
    limit = np.uint64(int(SAMPLED * 2**64))
    width = np.uint64(-(-int(SAMPLED * 2**64) // buckets))

    def flush(rows: list[list], tokens: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        group = np.cumsum(first) - 1
        several = np.bincount(group, minlength=0) > 1
        own = np.bincount(owner, minlength=len(rows))
        shared = np.bincount(owner[several[group]] if len(owner) else owner, minlength=len(rows))
        token, owner = token[first], np.where(several, MANY, owner[first]).astype(np.uint16)
        bucket = (token // width).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
        low = token.astype(np.uint32)  # the lowest 32 bits
        blobs = [
            {"bucket": int(bucket[a]), "tokens": low[a:b].tobytes(), "owners": owner[a:b].tobytes()} for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
        listed = [dict(zip([*keys, "digest", "n_shingles", "n_own", "n_shared"], [*r, int(own[i]), int(shared[i])], strict=True)) for i, r in enumerate(rows)]
        name = hashlib.blake2b(repr(rows).encode(), digest_size=16).digest()
        return [{"pack": name, "docs": listed, "blobs": blobs}]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        rows, tokens, owners, held = [], [], [], 0
        for batch in wd.chunks(batches):
            target = target or pa.schema([
                ("pack", pa.binary()),
                ("docs", pa.list_(pa.struct([*[(x, batch.schema.field(x).type) for x in keys], ("digest", pa.binary()), ("n_shingles", pa.int64()), ("n_own", pa.int32()), ("n_shared", pa.int32())]))),
                ("blobs", pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary())]))),
            ])
            token, doc, w = shingles(wd.texts_of(batch.column("text")), k)
            count = np.bincount(doc, minlength=batch.num_rows)
            edges = np.searchsorted(w.doc, np.arange(batch.num_rows + 1))
            sampled = token < limit
            tokens.append(token[sampled])
            owners.append(doc[sampled] + len(rows))
            held += int(sampled.sum())
            listed = zip(*(batch.column(x).to_pylist() for x in keys), strict=True)
            rows += [[*key, hashlib.blake2b(w.hash[edges[i] : edges[i + 1]].tobytes(), digest_size=16).digest(), int(count[i])] for i, key in enumerate(listed)]
            if held >= FLUSH_KEYS or len(rows) >= FLUSH_DOCS - 10_000:
                yield pa.RecordBatch.from_pylist(flush(rows, tokens, owners), schema=target)
                rows, tokens, owners, held = [], [], [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(flush(rows, tokens, owners), schema=target)

    return docs.select(*keys, "text").mapInArrow(pack, schema)


def _shared_in_bucket(rows: pa.Table) -> pa.Table:
    """For each pack, the numbers of documents and how many of their tokens in this bucket occur in another pack."""
    sizes = np.array([len(x) // 4 for x in rows.column("tokens").to_pylist()], np.int64)
    token = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint32)
    owner = np.frombuffer(b"".join(rows.column("owners").to_pylist()), np.uint16)
    pack = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    twice = np.zeros(len(token), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    found = twice & (owner != MANY)
    both, count = np.unique(pack[found].astype(np.int64) * 65536 + owner[found], return_counts=True)
    return pa.table({
        "pack": rows.column("pack").take(pa.array(both // 65536)), "number": pa.array((both % 65536).astype(np.int32)), "count": pa.array(count.astype(np.int64)),
    })


def sharing(docs: DataFrame, keys: list[str], k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """keys, digest (of the words), n_shingles and shares: false for rows that can be linked with no other."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / 6 * SAMPLED / BUCKET_KEYS))
    packs = written(_packs(docs, keys, buckets, k, percent), "packs")
    blobs = packs.select("pack", F.explode("blobs").alias("b")).select("pack", "b.*")
    counts = blobs.groupBy("bucket").applyInArrow(_shared_in_bucket, "pack binary, number int, count bigint").groupBy("pack", "number").agg(F.sum("count").alias("count"))
    rows = packs.select("pack", F.posexplode("docs").alias("number", "d")).select("pack", "number", "d.*")
    joined = rows.join(counts, ["pack", "number"], "left")
    alone = F.col("n_own") - F.col("n_shared") - F.coalesce(F.col("count"), F.lit(0))
    most = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100)
    return joined.select(*keys, "digest", "n_shingles", ((F.col("n_shingles") > 0) & (alone <= most)).alias("shares"))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """node, n, tokens (distinct, rising, packed) of each text."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.chunks(batches):
            token, doc, _ = shingles(wd.texts_of(batch.column("text")), k)
            order = np.argsort(doc, kind="stable")
            token, edges = token[order], np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            packed = [token[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(edges)), pa.array(packed, pa.binary())], names=["node", "n", "tokens"])

    return texts.select("node", "text").mapInArrow(collect, "node bigint, n bigint, tokens binary")


def _unpacked(sets: DataFrame) -> DataFrame:
    """node, n, token: a row for each token."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                token = np.frombuffer(b"".join(some.column("tokens").to_pylist()), np.int64)
                n = some.column("n").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column("node").to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(token)], names=["node", "n", "token"])

    return sets.mapInArrow(unpack, "node bigint, n bigint, token bigint")


def _may_link(n: str, own: str, m: Column | str, percent: int) -> Column:
    """Whether a set of n tokens, ``own`` of which no other set has, can overlap enough with one of m tokens."""
    m = F.col(m) if isinstance(m, str) else m
    return (100 + percent) * (F.col(n) - F.col(own)) >= percent * (F.col(n) + m)


def prefix_tokens(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, n, own, token, before, ahead: the tokens that lie in the prefix of their set by rising frequency and that other sets also have.

    before is the set's token one place earlier in that order, null for the first.
    own counts the set's tokens that no other set has, ahead those and the tokens before this one: none of them is shared
    with a set that this token is the first to meet. A set is left out of a token's list if it has too many of those to
    link even with the smallest set of the list.
    """
    tokens = _unpacked(sets)
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    common = tokens.join(frequent, "token")
    place = Window.partitionBy("node").orderBy("df", "token")
    kept = common.withColumn("place", F.row_number().over(place)).withColumn("before", F.lag("token").over(place)).withColumn("own", F.col("n") - F.count("*").over(Window.partitionBy("node")))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # tokens that no other set has come first
    prefixes = kept.filter(F.col("own") + F.col("place") <= prefix).select("node", "n", "own", "token", "before", (F.col("own") + F.col("place") - 1).alias("ahead"))
    return _listed(written(prefixes, "prefixes"), percent)


def _listed(prefixes: DataFrame, percent: int) -> DataFrame:
    least = prefixes.groupBy("token").agg(F.min("n").alias("least"))
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    return prefixes.join(least, "token").filter(_may_link("n", "ahead", smallest, percent)).drop("least")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the ``pairs`` (a, b) whose sets link: they share prefix tokens under each hash order, then enough of all."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, candidate = min(len(s), len(t)), 100 * min(len(s), len(t)) >= percent * max(len(s), len(t))
                for order in ORDERS if candidate and least > 64 else ():
                    front = [np.sort(wd.mix(v * np.uint64(order)))[: len(v) - -(-percent * len(v) // 100) + 1] for v in (s, t)]
                    candidate = candidate and len(np.intersect1d(*front, assume_unique=True)) > 0
                both = len(np.intersect1d(s, t, assume_unique=True)) if candidate else 0
                kept.append(candidate and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    return left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _classes(sets: DataFrame, percent: int) -> DataFrame:
    """node, component over the sets that link."""
    nodes = sets.select("node")
    prefixes = written(prefix_tokens(sets, percent), "prefixes")
    ends = prefixes.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    met = prefixes.join(ends, "token").select("node", F.explode(F.array("low", "high")).alias("end"))
    stars = written(met.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).filter("a < b").distinct(), "pairs")
    links = written(linked(stars, sets, percent), "links")
    labels = components(nodes, links)
    # Prefix tokens that still have nodes of several classes. Nodes with the same token before have met there: each pair
    # is looked at where their prefixes first come together.
    came_from = (F.min("before").alias("from_low"), F.max("before").alias("from_high"), (F.count("before") < F.count("*")).alias("starts"))
    placed = prefixes.join(labels, "node")
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), *came_from)
    open_tokens = open_tokens.filter("low <> high AND (starts OR from_low <> from_high)").select("token")
    placed = written(_listed(placed.join(open_tokens, "token"), percent), "open")
    sizes = placed.select("component", "node").distinct().groupBy("component").agg(F.count("*").alias("size"))
    placed = placed.join(sizes, "component")
    reach = 100 * F.col("n") - (100 + percent) * F.col("ahead")  # a set links with none of more than reach / percent tokens
    classes = placed.groupBy("token", F.col("component").alias("other"), F.col("size").alias("other_size")).agg(
        *came_from, F.min("n").alias("other_least"), F.max(reach).alias("other_reach")
    )
    # each node of the smaller class meets the larger one
    smaller = (F.col("size") < F.col("other_size")) | (F.col("size") == F.col("other_size")) & (F.col("component") < F.col("other"))
    met_before = F.coalesce((F.col("from_low") == F.col("before")) & (F.col("from_high") == F.col("before")), F.lit(False)) & ~F.col("starts")
    fits = (reach >= percent * F.col("other_least")) & (F.col("other_reach") >= percent * F.col("n"))
    across = placed.join(classes, "token").filter(smaller & ~met_before & fits)
    across = written(across.select("node", "n", "own", "other", "other_size").distinct(), "across")
    members = placed.select(F.col("component").alias("other"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("own").alias("m_own")).distinct()
    rest = across.filter(F.col("other_size") <= FEW_NODES).join(members, "other").filter(
        _may_link("n", "own", "m", percent) & _may_link("m", "m_own", "n", percent)
    )
    rest = rest.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    one_by_one = linked(rest, sets, percent)
    in_blocks = _linked_blocks(across.filter(F.col("other_size") > FEW_NODES).select("node", "other"), members.select("other", "b"), sets, percent)
    more = written(one_by_one.unionByName(in_blocks), "links")
    return merged_components(labels, more)


def _linked_blocks(visits: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the links between each visiting node (``visits``: node, other) and the ``members`` (other, b) of the class it visits.

    Members and visitors meet in blocks of both, so a large class makes rows for its blocks, not for its pairs.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("count") / BLOCK_NODES)).cast("int")
    count = lambda df: df.groupBy("other").agg(F.count("*").alias("count"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK_NODES) - 1).cast("int")))
    visitors, held = count(visits), members.join(visits.select("other").distinct(), "other", "left_semi")
    numbers = visitors.withColumnRenamed("count", "visitors").join(count(held).withColumnRenamed("count", "held"), "other")
    left = visits.join(numbers, "other").withColumn("count", F.col("visitors")).withColumn("x_block", block("node")).withColumn("y_block", spread("held"))
    right = held.join(numbers, "other").withColumn("count", F.col("held")).withColumn("y_block", block("b")).withColumn("x_block", spread("visitors"))
    rows = left.select("other", "x_block", "y_block", "node", F.lit(True).alias("visits")).unionByName(
        right.select("other", "x_block", "y_block", F.col("b").alias("node"), F.lit(False).alias("visits"))
    )

    def compare(rows: pa.Table) -> pa.Table:
        node, visits = rows.column("node").to_numpy(), rows.column("visits").to_numpy()
        n = rows.column("n").to_numpy()
        token = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint64)
        kinds, column = np.unique(token, return_inverse=True)
        row = np.repeat(np.arange(len(node)), n)
        y = np.flatnonzero(~visits)
        both = np.zeros((int(visits.sum()), len(y)), np.float32)
        x = np.flatnonzero(visits)
        for low in range(0, len(kinds), 4096):  # dense in slices of the tokens
            on = (column >= low) & (column < low + 4096)
            dense = np.zeros((len(node), min(4096, len(kinds) - low)), np.float32)
            dense[row[on], column[on] - low] = 1
            both += dense[x] @ dense[y].T
        i, j = np.nonzero((100 + percent) * both >= percent * (n[x][:, None] + n[y][None, :]))
        a_out, b_out = node[x[i]], node[y[j]]
        return pa.table({"a": np.minimum(a_out, b_out), "b": np.maximum(a_out, b_out)})

    with_sets = rows.join(sets.select("node", "n", "tokens"), "node")
    return with_sets.groupBy("other", "x_block", "y_block").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_id (md5 of the text), n_shingles and component_id (the smallest doc_id of its class) of each row.

    Null texts and texts without words have no shingles, are linked with nothing and are their own class. Rows that share
    a doc_id keep their own texts; a null doc_id counts only if its class has no other. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"), "text")
    rows = written(sharing(docs, ["doc_id", "text_id"], k, percent), "rows")
    # one text of each sequence of words
    chosen = rows.filter("shares").groupBy("digest", "text_id").agg(F.min("doc_id").alias("id"))
    chosen = chosen.groupBy("digest").agg(F.min(F.struct("text_id", "id")).alias("c")).select("c.*")
    texts = docs.alias("d").join(chosen.alias("c"), (F.col("d.text_id") == F.col("c.text_id")) & F.col("d.doc_id").eqNullSafe(F.col("c.id")))
    texts = written(texts.select("d.text_id", "d.text").dropDuplicates(["text_id"]), "texts")
    again = sharing(texts, ["text_id"], k, percent).filter("shares").select("text_id", "digest")
    nodes = written(texts.join(again, "text_id").withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = _classes(written(_sets(nodes, k), "sets"), percent)
    named = nodes.select("node", "digest").join(found, "node").select("digest", "component")
    roots = named.groupBy("component").agg(F.min("digest").alias("root"))
    named = written(named.join(roots, "component").select("digest", "root"), "roots")
    rows = rows.join(named, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    lowest = rows.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("lowest")).withColumnRenamed("root", "r")
    joined = rows.join(lowest, (F.col("root") == F.col("r")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "text_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all documents."""
    return similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = None  # components need iteration; tested against brute force
