"""Order-book summaries per snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket, div
from ..plans.ordered import top_k


def book_cluster(book: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Quantity per price bucket and side; ``lo``/``hi`` are the extreme prices in the bucket."""
    return (
        book.groupBy(*keys, "side", bucket("px", size).alias("price"))
        .agg(F.sum("qty").alias("qty"), F.min("px").alias("lo"), F.max("px").alias("hi"))
        .filter("qty > 0")
    )


def book_walls(clusters: DataFrame, keys: Sequence[str], times: float = 3.0) -> DataFrame:
    """Buckets holding at least ``times`` the side's mean quantity; a side needs three buckets."""
    w = Window.partitionBy(*keys, "side")
    return (
        clusters.withColumns({"mean_qty": F.avg("qty").over(w), "buckets": F.count(F.lit(1)).over(w)})
        .filter((F.col("buckets") >= 3) & (F.col("qty") >= F.col("mean_qty") * times))
        .drop("buckets")
    )


def book_summary(clusters: DataFrame, keys: Sequence[str], range_pct: float = 0.005) -> DataFrame:
    """Best prices, mid, spread, and the quantity imbalance of the buckets near the mid.

    A snapshot has one row per bucket here, so the window and the sums after it share one small shuffle.
    """
    w = Window.partitionBy(*keys)
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    rows = clusters.withColumns(
        {
            "best_bid": F.max(F.when(bid, F.col("hi"))).over(w),
            "best_ask": F.min(F.when(ask, F.col("lo"))).over(w),
        }
    ).withColumn("mid", (F.coalesce("best_bid", F.lit(0.0)) + F.coalesce("best_ask", F.lit(0.0))) / 2)
    near_bid = bid & (F.col("price") >= F.col("mid") * (1 - range_pct))
    near_ask = ask & (F.col("price") <= F.col("mid") * (1 + range_pct))
    b, a = F.col("total_bid"), F.col("total_ask")
    return (
        rows.groupBy(*keys, "best_bid", "best_ask", "mid")
        .agg(
            F.sum(F.when(near_bid, F.col("qty")).otherwise(0.0)).alias("total_bid"),
            F.sum(F.when(near_ask, F.col("qty")).otherwise(0.0)).alias("total_ask"),
        )
        .withColumns({"spread": F.col("best_ask") - F.col("best_bid"), "imbalance": div(b - a, b + a)})
    )


def topk_levels(clusters: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k best levels per side: highest bids, lowest asks."""
    best_first = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return top_k(clusters, [*keys, "side"], [best_first], k)
