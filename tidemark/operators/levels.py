"""Price levels from several sources and where they meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_levels(parts: Sequence[DataFrame], spot: float) -> DataFrame:
    """``key price label source`` of all parts as one ladder with the distance from the spot."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    dist = (F.col("price") - spot) / spot * 100
    return out.filter("price IS NOT NULL").withColumns(
        {"dist_pct": dist, "above": F.col("price") > spot, "near": F.abs(dist) < 1}
    )


def cross_levels(levels: DataFrame, keys: Sequence[str], within: float = 10.0) -> DataFrame:
    """Pairs of levels from different sources closer than ``within``, higher price first.

    A level only meets levels in its own price bucket and the one below.
    """
    keys = list(keys)
    k = F.floor(F.col("price") / within)
    cols = ["price", "label", "source"]
    hi = levels.select(*keys, F.struct(*cols).alias("hi"), F.explode(F.array(k, k - 1)).alias("__k"))
    lo = levels.select(*keys, F.struct(*cols).alias("lo"), k.alias("__k"))
    a, b = F.col("hi.price"), F.col("lo.price")
    ordered = (a > b) | ((a == b) & (F.col("hi.source") < F.col("lo.source")))
    return (
        hi.join(lo, [*keys, "__k"])
        .filter((F.col("hi.source") != F.col("lo.source")) & ordered & (a - b < within))
        .select(*keys, ((a + b) / 2).alias("price"), F.col("hi.label").alias("label_hi"), F.col("lo.label").alias("label_lo"),
                F.col("hi.source").alias("source_hi"), F.col("lo.source").alias("source_lo"), (a - b).alias("gap"))
    )
