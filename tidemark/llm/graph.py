"""Connected components of a link table, by contraction to stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle


def _to_least(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node ``u`` to the least node around it.

    larger: only the neighbours above ``u`` move; otherwise only those below it, and ``u`` itself.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        moved = pairs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        moved = pairs.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _stamp(edges: DataFrame) -> tuple:
    """A digest of a set of links."""
    return tuple(edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the least node reachable.

    Alternates two contractions until every node hangs on its component's least node. Each round is written to the
    shared folder, so a lost executor costs one round; minima are combined before the shuffle and a node with very
    many neighbours is split by the adaptive skew join. Null ends are ignored.
    """
    edges = settle(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _stamp(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True)
        edges, before = settle(_to_least(large, False)), seen
        seen = _stamp(edges)
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
