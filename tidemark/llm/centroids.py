"""Centroid clustering of integer vectors in Spark's own expressions.

Centroids are a literal array of arrays in the plan (clusters x dimensions numbers, whatever the input). A vector's
squared distance to each is ``zip_with`` and ``aggregate`` over 64-bit integers; the least (distance, number) struct is
its cluster. An update is one grouped aggregation with a sum column for each dimension; a cluster, however large, leaves
each task as one row. All sums are integers, so nothing depends on the order of rows, tasks or retries.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle

LARGEST = 1 << 27  # of a component as integer: 64 squared differences still fit 63 bits


def integral(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with ``dims`` finite components below LARGEST / scale."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < float(LARGEST)))
    return vectors.filter((F.size(x) == dims) & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def first_by_hash(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; of a repeated id the lesser vector comes first.

    Rows without an id start no cluster.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in rows.filter("vec_id IS NOT NULL").orderBy(key, "v").limit(k).collect()]


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """struct<distance, cluster> of the nearest centroid to the array column ``v``; ties go to the smaller number."""
    table = F.from_json(F.lit(json.dumps(centroids)), "array<array<long>>")  # folded into one literal
    square = lambda a, b: (a - b) * (a - b)
    add = lambda total, x: total + x
    from_each = F.transform(table, lambda c, i: F.struct(
        F.aggregate(F.zip_with(v, c, square), F.lit(0).cast("long"), add).alias("distance"), i.alias("cluster")))
    return F.array_min(from_each)


def updated(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floored mean of each cluster's vectors; a cluster without vectors keeps its centroid."""
    dims = len(centroids[0])
    sums = [F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(dims)]
    found = rows.select(nearest("v", centroids)["cluster"].alias("cluster"), "v")
    out = list(centroids)
    for r in found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row a cluster
        out[r.cluster] = [r[f"s{j}"] // r.n for j in range(dims)]
    return out


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, dims: int = 64, k: int = 40,
              rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """Each vector's cluster and squared distance after ``rounds`` updates, with the clusters' and the total inertia.

    A component x counts as floor(scale * x). Rows take no part when their vector is null, has not exactly ``dims``
    components, holds a null or non-finite one or one of 2^27 / scale or more (whose squares would not fit). Repeated
    rows each count; rows without an id are assigned but start no cluster; with fewer than ``k`` rows that have an id
    there are as many clusters, and without any the result is empty. ``cluster_inertia`` and ``inertia`` are null where
    they need more than 63 bits. ``centroid_sha256`` digests the components of the row's centroid, as decimal integers
    joined by commas. An empty table gives an empty result. Other columns are not read.
    """
    rows = settle(integral(vectors, id_col, vec_col, dims, scale))
    centroids = first_by_hash(rows, k, seed)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], kinds)
    for _ in range(rounds):
        centroids = updated(rows, centroids)
    found = settle(rows.select("vec_id", nearest("v", centroids).alias("m")).select("vec_id", "m.cluster", "m.distance"))
    wide = F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(wide).collect()}  # a row a cluster
    fits = lambda s: F.lit(s if s < 1 << 63 else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return found.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[fits(own.get(i, 0)) for i in range(len(centroids))]), at).alias("cluster_inertia"),
        fits(sum(own.values())).alias("inertia"),
        F.element_at(F.array(*[F.lit(x) for x in digest]), at).alias("centroid_sha256"),
    )
