"""Exact top-k by inner product: distributed histogram selection.

Every query is scored against every row, several times over. A pass turns the scores of the range that still matters
into 256 bins per query; the bins of all tasks are summed, and the bin that holds the query's k-th best score becomes
the next range, until it is one score wide. That score is exact, so a last pass keeps what lies above it and, of the
rows that tie with it, the ones with the least ids. Scores themselves are never moved: a pass sends counts.

Queries are taken in slices of ``SLICE`` (by a hash of their id), which bounds what a task is sent; the number of
slices, not their size, grows with the query set.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import settle
from .arrays import in_batches, lean

SLICE = 4096
BINS = 256


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows without an id or a fully finite vector are left out."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & sound & (F.size(x) > 0))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))
    )


def _matrix(batch):
    """(ids, vectors as a matrix) for each vector length of an Arrow batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], flat[(at[rows, None] + np.arange(d)).ravel()].reshape(-1, d)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles where they are exact, else 64-bit integers (which wrap, as Spark's do)."""
    top = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0))
    if top * rows.shape[1] < 2**53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def _counted(rows: DataFrame, q_id, q_vec, low, shift) -> DataFrame:
    """(q, bin, c): how many scores of each query fall into each bin of its range; BINS counts those above the range."""
    nq = len(q_id)

    @lean
    def run(batches):
        total = np.zeros(nq * (BINS + 1), np.int64)
        for batch in batches:
            for ids, x in _matrix(batch):
                for q in _of_length(q_vec, x.shape[1]):
                    s = _scores(np.stack([q_vec[i] for i in q]), x)
                    use = (s >= low[q, None]) & (ids[None, :] != q_id[q, None])
                    i, j = np.nonzero(use)
                    # the difference may pass 2^63, so it is taken without sign
                    b = (s[i, j].astype(np.uint64) - low[q][i].astype(np.uint64)) >> shift[q][i].astype(np.uint64)
                    b = np.minimum(b, np.uint64(BINS)).astype(np.int64)
                    total += np.bincount(q[i] * (BINS + 1) + b, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // (BINS + 1)), pa.array(at % (BINS + 1)), pa.array(total[at])],
                                         names=["q", "bin", "c"])

    return in_batches(rows).mapInArrow(run, "q long, bin long, c long").groupBy("q", "bin").agg(F.sum("c").alias("c"))


def _of_length(q_vec, d: int) -> list[np.ndarray]:
    at = np.array([i for i, v in enumerate(q_vec) if len(v) == d], np.int64)
    return [at] if len(at) else []


def _kept(rows: DataFrame, q_id, q_vec, least, k: int) -> DataFrame:
    """(query_id, vec_id, score) at or above each query's k-th score; of ties with it the k least ids of a batch."""

    @lean
    def run(batches):
        for batch in batches:
            for ids, x in _matrix(batch):
                for q in _of_length(q_vec, x.shape[1]):
                    s = _scores(np.stack([q_vec[i] for i in q]), x)
                    i, j = np.nonzero((s >= least[q, None]) & (ids[None, :] != q_id[q, None]))
                    order = np.lexsort((ids[j], -s[i, j].astype(float), i))
                    i, j = i[order], j[order]
                    tie = s[i, j] == least[q][i]
                    start = np.searchsorted(i, i)
                    above = np.concatenate(([0], np.cumsum(~tie)))
                    place = np.arange(len(i)) - start - (above[:-1] - above[start])  # among the ties of the query
                    keep = ~tie | (place < k)
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_id[q][i]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    return in_batches(rows).mapInArrow(run, "query_id long, vec_id long, score long")


def _slice_result(rows: DataFrame, q_id, q_vec, reach: float, k: int) -> DataFrame:
    norm = np.array([np.linalg.norm(v.astype(float)) for v in q_vec])
    bound = np.minimum(np.ceil(norm * reach * (1 + 1e-9)) + 1, 2.0**62)  # no score is further from zero
    wraps = norm * reach >= 2.0**62
    low = np.where(wraps, -(2**63), -bound.astype(np.int64))
    bits = np.where(wraps, 64, np.ceil(np.log2(2 * bound + 1)).astype(np.int64))
    shift = np.maximum(bits - 8, 0)
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    while True:
        counts = _counted(rows, q_id, q_vec, low, shift)
        cum = counts.withColumn("cum", F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        found = cum.filter(F.col("cum") >= k).groupBy("q").agg(F.max("bin").alias("bin")).collect()  # a row a query
        moved = False
        for r in found:
            low[r.q] = int(low[r.q]) + (r.bin << int(shift[r.q]))
            moved |= bool(shift[r.q])
            shift[r.q] = max(int(shift[r.q]) - 8, 0)
        if not moved:
            break
    return _kept(rows, q_id, q_vec, low, k)


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row that satisfies ``is_query``.

    ``is_query`` is a condition on the column ``id``. The score is the integer inner product of the vectors with
    components floor(scale * x); ties go to the smaller id; a query with fewer other rows gets all of them. Rows without
    an id, with a null or empty vector or with a null or non-finite component take no part, neither as query nor as
    candidate; vectors of different lengths are not compared. Of a repeated id every row is a candidate of its own, save for
    queries of that id; if several rows of an id are queries, the best of all their scores are returned under it. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = settle(quantized(vectors, id_col, vec_col, scale))
    queries = rows.filter(is_query)
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    reach = float(rows.agg(F.sqrt(F.max(square))).first()[0] or 0.0)
    slices = max(1, -(-queries.count() // SLICE))
    parts = []
    for i in range(slices):
        got = queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(slices)) == i).orderBy("id", "v").collect()  # about SLICE rows
        if got:
            q_id = np.array([r.id for r in got], np.int64)
            parts.append(_slice_result(rows, q_id, [np.array(r.v, np.int64) for r in got], reach, k))
    schema = "query_id long, vec_id long, score long"
    kept = reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
