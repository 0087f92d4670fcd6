"""Decoding of Gaussian hidden Markov models, cut into blocks of bars so that no key has to fit in a task.

Within a block the chain is a pair of K x K tables, from the state before the block to the state of its last bar: sums of
path probabilities, and the best path's. Tables of neighbouring blocks compose, FAN at a time, in rounds that grow with
the logarithm of the number of blocks. On the way down every block learns what it needs of the rest of its key: how
likely each state is before it (``fwd``) and after it (``back``), and the best path's states at its two ends. The bars of
a block are then decoded with no other block at hand. All tables are logarithms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import numbered
from ..plans.settle import settle
from .indicators import last_rows

BLOCK = 512  # bars
FAN = 64  # tables composed at a time
TINY = 1e-300

DECODE_SCHEMA = (
    "ts timestamp, state int, label string, smoothed int, confidence double, entropy double, posterior array<double>"
)
TABLES = "block long, paths array<double>, best array<double>"
CARRY = "fwd array<double>, back array<double>, before int, last int"
MODEL = ["start", "trans", "means", "vars", "feature_mean", "feature_std"]


def emit(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log densities, (..., T, K), of diagonal Gaussians."""
    d = x[..., :, None, :] - mu[..., None, :, :]
    return -0.5 * (np.log(2 * np.pi * var).sum(-1)[..., None, :] + (d * d / var[..., None, :, :]).sum(-1))


def label_order(mu: np.ndarray) -> list[str]:
    """Canonical names of a four-state model's states by (realized_vol, log_return) means, columns 1 and 0."""
    by_vol = sorted(range(4), key=lambda s: (-mu[s, 1], s))
    out = [""] * 4
    for pair, names in ((by_vol[:2], ("STRESS", "CRASH")), (by_vol[2:], ("UP", "CHOP"))):
        hi, lo = sorted(pair, key=lambda s: (-mu[s, 0], s))
        out[hi], out[lo] = names
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def _square(flat) -> np.ndarray:
    k = int(round(len(flat) ** 0.5))
    return np.asarray(flat, float).reshape(k, k)


def _rows(nested) -> np.ndarray:
    return np.array([list(r) for r in nested], float)


def _densities(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log densities of a block's bars, the transition matrix and the means of its key's model."""
    mu = _rows(row.means)
    x = (np.asarray(row.x, float).reshape(len(row.ts), -1) - np.asarray(row.feature_mean)) / np.asarray(row.feature_std)
    return emit(x, mu, _rows(row.vars)), _rows(row.trans), mu


def _tables(logb: np.ndarray, a: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(paths, best) of a block; a key's first block starts in the state of its first bar."""
    la = np.log(a + TINY)
    best = np.where(np.eye(len(a), dtype=bool), logb[0], -np.inf) if first else la + logb[0]
    scale = best.max(1, keepdims=True)  # of each row its own: rows may be far apart
    p = np.exp(best - scale)
    for b in logb[1:]:
        best = (best[:, :, None] + la).max(1) + b
        p = (p @ a) * np.exp(b - b.max())
        total = np.maximum(p.sum(1, keepdims=True), TINY)
        p /= total
        scale += np.log(total) + b.max()
    with np.errstate(divide="ignore"):
        return np.log(p) + scale, best


def _carried(paths, best, fwd, back, before: int, last: int):
    """The carries of successive blocks, from the carry of all of them together; ``last`` below 0: the best end is open."""
    k = len(fwd)
    at = [fwd]
    # the best path starts where the blocks before end it; a key's first block is open
    score = [fwd if before < 0 else np.where(np.arange(k) == before, 0.0, -np.inf)]
    for p, m in zip(paths, best):
        f, s = _log_sum(at[-1][:, None] + p, 0), (score[-1][:, None] + m).max(0)
        at.append(f - f.max())
        score.append(s - s.max())
    end = int(score[-1].argmax()) if last < 0 else last
    out = []
    for i in range(len(paths) - 1, -1, -1):
        start = before if i == 0 else int((score[i] + best[i][:, end]).argmax())
        out.append((at[i], back, start, end))
        back = _log_sum(paths[i] + back, 1)
        back = back - back.max()
        end = start
    return out[::-1]


def _decoded(logb: np.ndarray, a: np.ndarray, fwd, back, before: int, last: int):
    """States of the best path and posteriors of a block's bars."""
    t, k = logb.shape
    la = np.log(a + TINY)
    top = logb.max(1, keepdims=True)
    b = np.exp(logb - top)
    enter = fwd + logb[0] if before < 0 else _log_sum(fwd[:, None] + la, 0) + logb[0]
    al, be = np.empty((t, k)), np.empty((t, k))
    f = np.exp(enter - enter.max())
    for i in range(t):
        if i:
            f = (al[i - 1] @ a) * b[i]
        al[i] = f / max(f.sum(), TINY)
    be[-1] = np.exp(back - back.max())
    for i in range(t - 2, -1, -1):
        g = a @ (b[i + 1] * be[i + 1])
        be[i] = g / max(g.max(), TINY)
    post = al * be
    post /= np.maximum(post.sum(1, keepdims=True), TINY)

    score, step = (fwd if before < 0 else la[before]) + logb[0], np.zeros((t, k), int)
    for i in range(1, t):
        ways = score[:, None] + la
        step[i] = ways.argmax(0)
        score = ways.max(0) + logb[i]
    path = np.empty(t, int)
    path[-1] = last
    for i in range(t - 2, -1, -1):
        path[i] = step[i + 1][path[i + 1]]
    return path, post


def _schema(df: DataFrame, names: Sequence[str], rest: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*[f"`{c}` {types[c]}" for c in names], rest])


def _blocks(rows: DataFrame, models: DataFrame, keys: list[str], names: list[str], size: int) -> DataFrame:
    """One row per key and block: its bars' times and features in order, and the key's model."""
    placed = numbered(rows.select(*keys, "ts", *names), keys, ["ts"]).withColumn("block", F.floor((F.col("__rn") - 1) / size))
    bar = F.struct("__rn", "ts", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    held = placed.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(bar)).alias("b"))  # ``size`` bars at most
    held = held.select(*keys, "block", F.col("b.ts").alias("ts"), F.flatten("b.x").alias("x"))
    return held.join(models.select(*keys, *MODEL), keys)


def _composed(tables: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """The tables of ``fan`` successive blocks as one."""

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        p, m = _square(pdf["paths"].iloc[0]), _square(pdf["best"].iloc[0])
        for q, n in zip(pdf["paths"].iloc[1:], pdf["best"].iloc[1:]):
            q, n = _square(q), _square(n)
            p, m = _log_sum(p[:, :, None] + q, 1), (m[:, :, None] + n).max(1)
            shift = p.max(), m.max()
            p, m = p - shift[0], m - shift[1]  # only differences count
        out = pdf.head(1)[[*keys, "up"]].rename(columns={"up": "block"})
        return out.assign(paths=[p.ravel().tolist()], best=[m.ravel().tolist()])

    rows = tables.withColumn("up", F.floor(F.col("block") / fan))
    return rows.groupBy(*keys, "up").applyInPandas(compose, _schema(tables, keys, TABLES))


def _given(tables: DataFrame, carry: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Each block's carry from the carry of the ``fan`` blocks it belongs to."""

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        one = pdf.iloc[0]
        got = _carried(
            [_square(x) for x in pdf["paths"]], [_square(x) for x in pdf["best"]],
            np.asarray(one["fwd"], float), np.asarray(one["back"], float), int(one["before"]), int(one["last"]))
        out = pdf[[*keys, "block"]].reset_index(drop=True)
        return out.assign(fwd=[g[0].tolist() for g in got], back=[g[1].tolist() for g in got],
                          before=[g[2] for g in got], last=[g[3] for g in got])

    rows = tables.withColumn("up", F.floor(F.col("block") / fan)).join(carry.withColumnRenamed("block", "up"), [*keys, "up"])
    return rows.groupBy(*keys, "up").applyInPandas(give, _schema(tables, keys, f"block long, {CARRY}"))


def hmm_decode(
    features: DataFrame, models: DataFrame, keys: Sequence[str], names: Sequence[str], bars: int | None = None,
    block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """Viterbi state and smoothed posterior per bar under each key's model; with ``bars``, of its newest rows only.

    A task holds ``block`` bars or ``fan`` K x K tables of a key at a time, however many bars the key has. Keys without a
    model, or null, give no rows; features may not be null.
    """
    keys, names = list(keys), list(names)
    rows = features if bars is None else last_rows(features, keys, bars)
    blocks = settle(_blocks(rows, models, keys, names, block))

    def tables(batches):
        for pdf in batches:
            got = [_tables(*_densities(r)[:2], r.block == 0) for r in pdf.itertuples()]
            yield pdf[[*keys, "block"]].assign(paths=[g[0].ravel().tolist() for g in got], best=[g[1].ravel().tolist() for g in got])

    levels = [settle(blocks.mapInPandas(tables, _schema(blocks, keys, TABLES)))]
    top = levels[0].agg(F.max("block")).first()[0] or 0
    while top >= fan:
        levels.append(settle(_composed(levels[-1], keys, fan)))
        top //= fan
    # what is known of a key as a whole: how it starts, nothing beyond its end, and no state of the best path
    start = F.transform("start", lambda p: F.log(p + F.lit(TINY)))
    carry = models.select(*keys, F.lit(0).cast("long").alias("block"), start.alias("fwd"),
                          F.transform("start", lambda _: F.lit(0.0)).alias("back"), F.lit(-1).alias("before"), F.lit(-1).alias("last"))
    for level in reversed(levels):
        carry = _given(level, carry, keys, fan)

    cols = [*keys, *[c.split()[0] for c in DECODE_SCHEMA.split(", ")]]

    def decode(batches):
        for pdf in batches:
            for r, key in zip(pdf.itertuples(), pdf[keys].to_dict("records")):
                logb, a, mu = _densities(r)
                path, post = _decoded(logb, a, np.asarray(r.fwd, float), np.asarray(r.back, float), r.before, r.last)
                labels = label_order(mu) if len(mu) == 4 else [f"S{i}" for i in range(len(mu))]
                yield pd.DataFrame({
                    **key, "ts": r.ts, "state": path, "label": [labels[s] for s in path], "smoothed": post.argmax(1),
                    "confidence": post.max(1), "entropy": -(post * np.log(post + 1e-12)).sum(1), "posterior": list(post)})[cols]

    return blocks.join(carry, [*keys, "block"]).mapInPandas(decode, _schema(blocks, keys, DECODE_SCHEMA))
