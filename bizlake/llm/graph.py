"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlake.llm.store import written


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (the smallest node that its links reach) for ``nodes`` (node) and ``links`` (a, b).

    In each round a node points at the smallest node next to it, pointers are followed to their roots, and the links are drawn
    anew between roots; links inside a root are gone, so later rounds see few. A root is the smallest node of its tree.
    A hub is a hot key only on the side of a join that can be split; pointers are unique.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = nodes.select("node", F.col("node").alias("component"))
    while edges.limit(1).count():
        roots = _roots(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root")))
        named = labels.join(roots.select(F.col("node").alias("component"), "root"), "component", "left")
        labels = written(named.select("node", F.coalesce("root", "component").alias("component")), "labels")
        left = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        both = left.join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(both.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return labels


def merged_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more ``links`` (a, b): only the classes that they touch are linked anew."""
    left = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
    between = left.join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    between = written(between.distinct(), "between")
    touched = between.select("a").unionByName(between.select(F.col("b").alias("a"))).distinct()
    roots = components(touched.select(F.col("a").alias("node")), between)
    named = labels.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    return named.select("node", F.coalesce("root", "component").alias("component"))


def _roots(pointers: DataFrame) -> DataFrame:
    """node, root: where following the pointers (node, root) ends; each round doubles the steps that a pointer spans."""
    pointers = written(pointers, "roots")
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(pointers.join(ahead, "root").select("node", F.col("root").alias("before"), F.col("next").alias("root")), "roots")
        pointers = jumped.select("node", "root")
        if jumped.filter("before <> root").limit(1).count() == 0:
            return pointers
