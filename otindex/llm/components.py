"""Connected components of a large graph by grouped minima, pointer jumping and contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otindex.session import SALTS, materialize


def _least(*columns: Column) -> Column:
    return reduce(lambda a, b: F.when(b < a, b).otherwise(a), columns)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join, inner or left, on ``key``, which is unique in ``right`` and may hold very many rows of ``left``.

    The rows of a key are dealt by hash of column ``by`` to several tasks, each with a copy of the
    right-hand row. Meant for a right side much smaller than the left one.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label): the end of each node's way through ``parents(node, label)``, where ends are their own parents.

    A label is replaced by that label's own label until none moves, which halves the ways each time. Labels of
    very many nodes are dealt to several tasks.
    """
    while True:
        used = parents.select("label").distinct()
        ahead = used.join(parents.select(F.col("node").alias("label"), F.col("label").alias("ahead")), "label")
        moved = materialize(spread_join(parents, ahead, "label", "node").select("node", "label", "ahead"))
        parents = moved.select("node", F.col("ahead").alias("label"))
        if moved.where(F.col("label") != F.col("ahead")).isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of the links (a, b).

    Nodes of any orderable type, also structs. Each round takes the least neighbour of every node as its parent
    (a grouped minimum, combined before the shuffle, so a node with very many links is no burden), follows the
    parents to their ends and puts these in place of the nodes in all links. What joins the same ends is dropped,
    so at least every second node goes, and a link is joined again only while its ends are apart. Nodes
    with very many links and labels of very many nodes are dealt to several tasks. Every step is a
    checkpoint; rounds end when no link is left. Links to oneself and repeated links do no harm.
    """
    low, high = _least(F.col("a"), F.col("b")), F.when(F.col("b") < F.col("a"), F.col("a")).otherwise(F.col("b"))
    left = materialize(links.select(low.alias("a"), high.alias("b")).distinct())
    labels = None
    while True:
        ends = left.select(F.col("b").alias("node"), "a").union(left.select("a", "a"))
        roots = _roots(materialize(ends.groupBy("node").agg(F.min("a").alias("label"))))
        if labels is None:
            labels = roots
        else:
            further = roots.select(F.col("node").alias("label"), F.col("label").alias("further"))
            further = spread_join(labels, further, "label", "node", "left")
            labels = materialize(further.select("node", F.coalesce("further", "label").alias("label")))
        for end, other in (("a", "b"), ("b", "a")):
            root = roots.select(F.col("node").alias(end), F.col("label").alias("root"))
            left = spread_join(left, root, end, other).select(F.col("root").alias(end), other)
        left = materialize(left.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct())
        if left.isEmpty():
            return labels
