"""Regimes: Markov chains as tables and small matrices, and Gaussian hidden Markov models fitted in parallel groups.

A K x K matrix is an array of arrays in one row per key, multiplied with higher-order functions; Python runs only where hidden
Markov models are fitted. They are decoded in ``decoding``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, ladder
from ..plans.ordered import numbered, row_frames, running_last, top_k
from ..plans.settle import settle
from ..plans.ranks import exact_quantiles
from .decoding import emit, hmm_decode  # noqa: F401

# -- Markov chains -------------------------------------------------------------------------------------------------


def tercile_states(rows: DataFrame, keys: Sequence[str], ret: str, train: DataFrame | None = None) -> DataFrame:
    """State 0, 1, 2 by the terciles of the training rows (all rows by default)."""
    cuts = exact_quantiles(rows if train is None else train, keys, ret, {"lo": 1 / 3, "hi": 2 / 3}).drop("n")
    r = F.col(ret)
    return rows.join(cuts, list(keys)).withColumn(
        "state", ladder((r <= F.col("lo"), 0), (r >= F.col("hi"), 2), otherwise=F.lit(1))
    )


def split_windows(rows: DataFrame, train_end: str, val_end: str) -> DataFrame:
    ts = F.col("ts")
    return rows.withColumn(
        "part",
        ladder((ts <= F.lit(train_end).cast("timestamp"), "train"), (ts <= F.lit(val_end).cast("timestamp"), "val"),
               otherwise="test"),
    )


def transitions(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the next row's state as ``nxt`` (null at the end); numbers kept."""
    return numbered(states, keys, ["ts"], following={"nxt": F.col("state")})


def grid(keys_df: DataFrame, k: int) -> DataFrame:
    """Every (i, j) cell for every row of ``keys_df``."""
    states = F.sequence(F.lit(0), F.lit(k - 1))
    return keys_df.withColumn("i", F.explode(states)).withColumn("j", F.explode(states))


def transition_counts(states: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    keys = list(keys)
    seen = (
        transitions(states, keys)
        .filter("nxt IS NOT NULL")
        .groupBy(*keys, F.col("state").alias("i"), F.col("nxt").alias("j"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = grid(states.select(*keys).distinct(), k)
    return cells.join(seen, [*keys, "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def transition_probs(counts: DataFrame, keys: Sequence[str], k: int, alpha: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*keys, "i")  # one row of a K x K matrix
    return counts.withColumn("p", (F.col("n") + alpha) / (F.sum("n").over(w) + k * alpha))


def as_matrix(probs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long cells to one ``m`` array<array<double>> per key."""
    rows = probs.groupBy(*keys, "i").agg(F.sort_array(F.collect_list(F.struct("j", "p")))["p"].alias("row"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "row")))["row"].alias("m"))


def matmul(a: Column, b: Column, k: int) -> Column:
    def cell(row, j):
        terms = [F.get(row, F.lit(x)) * F.get(F.get(b, F.lit(x)), F.lit(j)) for x in range(k)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return F.transform(a, lambda row: F.array(*[cell(row, j) for j in range(k)]))


def matpow(m: str, h: int, k: int) -> Column:
    """The h-th power by repeated multiplication inside one expression."""
    steps = F.sequence(F.lit(2), F.lit(h)) if h >= 2 else F.array().cast("array<int>")
    return F.aggregate(steps, F.col(m), lambda acc, _: matmul(acc, F.col(m), k))


def square_up(m: str, times: int, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.col(m), lambda acc, _: matmul(acc, acc, k))


def cells(df: DataFrame, keys: Sequence[str], m: str = "m") -> DataFrame:
    rows = df.select(*keys, F.posexplode(m).alias("i", "__row"))
    return rows.select(*keys, "i", F.posexplode("__row").alias("j", "p"))


def multi_step(matrices: DataFrame, keys: Sequence[str], horizons: Sequence[int], k: int) -> DataFrame:
    """Cells of P^h for every horizon."""
    parts = F.array(*[F.struct(F.lit(h).alias("h"), matpow("m", h, k).alias("m")) for h in horizons])
    return cells(matrices.select(*keys, F.inline(parts)), [*keys, "h"])


def stationary(matrices: DataFrame, keys: Sequence[str], k: int, doublings: int = 13) -> DataFrame:
    """Long-run share and mean dwell per state: the uniform start after 2^13 steps of the chain."""
    limit = matrices.withColumn("__l", square_up("m", doublings, k))
    share = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda j: F.aggregate("__l", F.lit(0.0), lambda acc, row: acc + F.get(row, j)) / k,
    )
    out = limit.select(*keys, "m", F.posexplode(share).alias("state", "share"))
    stay = F.get(F.get("m", F.col("state")), F.col("state"))
    return out.select(*keys, "state", "share", div(F.lit(1.0), 1 - stay).alias("dwell"))


def chi2_tail(x: Column, dof: int) -> Column:
    """Upper tail of the chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, dof // 2):
        term = term * half / i
        total = total + term
    return F.exp(-half) * total


def homogeneity_g2(states: DataFrame, keys: Sequence[str], k: int, periods: int = 3) -> DataFrame:
    """Likelihood-ratio test that equal sub-periods share one transition matrix."""
    keys = list(keys)
    rows = transitions(states, keys)
    i0 = F.col("__rn") - 1
    cuts = [F.floor(F.col("__n") * F.lit(p) / periods) for p in range(1, periods)]
    period = sum((i0 >= c).cast("int") for c in cuts)
    ends = F.lit(False)
    for c in cuts:
        ends = ends | (F.col("__rn") == c)
    pairs = rows.withColumn("period", period).filter(F.col("nxt").isNotNull() & ~ends)
    # one row per key: every count is a column, the rest is arithmetic on it
    seen = pairs.groupBy(*keys).agg(*[
        F.count_if((F.col("period") == p) & (F.col("state") == i) & (F.col("nxt") == j)).alias(f"n_{p}_{i}_{j}")
        for p in range(periods) for i in range(k) for j in range(k)])
    n = lambda p, i, j: F.col(f"n_{p}_{i}_{j}")
    total = lambda cells: reduce(lambda a, b: a + b, cells)
    every = {(i, j): total(n(p, i, j) for p in range(periods)) for i in range(k) for j in range(k)}
    parts = []
    for i in range(k):
        pooled = total(every[i, j] for j in range(k))
        for p in range(periods):
            own = total(n(p, i, j) for j in range(k))
            for j in range(k):
                e = own * every[i, j] / F.nullif(pooled, F.lit(0))
                parts.append(F.when(n(p, i, j) > 0, 2 * n(p, i, j) * F.log(n(p, i, j) / e)).otherwise(0.0))
    dof = (periods - 1) * k * (k - 1)
    return seen.select(*keys, total(parts).alias("g2")).withColumns({"dof": F.lit(dof), "p": chi2_tail(F.col("g2"), dof)})


PRIME = 2**31 - 1
MIXERS = (48271, 69621, 16807)  # primitive roots of PRIME


def counter_draw(seed: int, keys: Sequence[str], counters: Sequence[Column], below: Column) -> Column:
    """A number from 0 to ``below`` - 1 that depends on the seed, the row's key and the counters alone.

    Every step stays under 2^62 in whole numbers, so another engine that has md5 and integers draws the same: the key's
    digest and the counters are taken in one by one, each spread by a multiplication modulo a prime.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]))
    x = F.conv(F.substring(key, 1, 7), 16, 10).cast("bigint")
    for part in counters:
        x = x + part.cast("bigint")
        for m in MIXERS:
            x = (x.bitwiseXOR(F.shiftright(x, 13)) * m + 12345) % PRIME
    return x % below


def block_bootstrap(
    states: DataFrame, keys: Sequence[str], k: int, draws: int, block: int = 20, alpha: float = 1.0, seed: int = 42
) -> DataFrame:
    """Percentile bands of the transition probabilities over block resamples.

    The transitions inside a block are known for every possible start, so a resample is a join of drawn starts with
    that table; the seam to the following block is drawn by the same numbers and joined too. Draws run in parallel.
    """
    keys = list(keys)
    pairs = [(i, j) for i in range(k) for j in range(k)]

    def add(rows, w):
        ahead = w.rowsBetween(0, block - 2)
        cols = {
            f"n_{i}_{j}": F.sum(F.when((F.col("state") == i) & (F.col("nxt") == j), 1).otherwise(0)).over(ahead)
            for i, j in pairs
        }
        return rows.withColumns({**cols, "last_state": F.lead("state", block - 1).over(w)})

    table = row_frames(transitions(states, keys), keys, ["ts"], add, ahead=block, keep_number=True)
    inner = [f"n_{i}_{j}" for i, j in pairs]
    starts = table.filter(F.col("__rn") <= F.col("__n") - block).select(
        *keys, F.col("__rn").alias("at"), F.col("state").alias("first_state"), "last_state", *inner
    )
    sizes = table.groupBy(*keys).agg(F.max("__n").alias("n"))
    draw = lambda m: counter_draw(seed, keys, [F.col("draw"), m], F.col("n") - block) + 1
    plan = (
        sizes.filter(F.col("n") > block)
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .withColumn("m", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / block).cast("int"))))
        .withColumns({"at": draw(F.col("m")), "then": draw(F.col("m") + 1)})
        .withColumn("seam", F.col("m") < F.floor(F.col("n") / block))
    )
    firsts = starts.select(*keys, F.col("at").alias("then"), F.col("first_state").alias("seam_to"))
    drawn = plan.join(starts, [*keys, "at"]).join(firsts, [*keys, "then"])
    total = lambda i, j: F.sum(
        F.col(f"n_{i}_{j}")
        + F.when(F.col("seam") & (F.col("last_state") == i) & (F.col("seam_to") == j), 1).otherwise(0)
    )
    counts = drawn.groupBy(*keys, "draw").agg(*[total(i, j).alias(f"c_{i}_{j}") for i, j in pairs])
    cell = lambda i, j: (F.col(f"c_{i}_{j}") + alpha) / (sum(F.col(f"c_{i}_{x}") for x in range(k)) + k * alpha)
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cell(i, j).alias("p")) for i, j in pairs])
    bands = F.percentile("p", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))  # over the draws, a parameter
    return (
        counts.select(*keys, F.inline(parts))
        .groupBy(*keys, "i", "j")
        .agg(bands.alias("b"), F.count(F.lit(1)).alias("draws"))
        .select(*keys, "i", "j", F.get("b", F.lit(0)).alias("lo"), F.get("b", F.lit(1)).alias("mid"),
                F.get("b", F.lit(2)).alias("hi"), "draws")
    )


def run_lengths(states: DataFrame, keys: Sequence[str], means: Sequence[str], top: int = 5) -> DataFrame:
    """The longest unbroken runs of each state with their mean values; ties go to the earlier run."""
    keys = list(keys)

    def add(rows, w):
        return rows.withColumn("__new", F.coalesce(F.lag("state").over(w) != F.col("state"), F.lit(True)))

    rows = settle(row_frames(states, keys, ["ts"], add, back=1, keep_number=True))
    rows = running_last(rows, keys, ["ts"], {"run": F.when(F.col("__new"), F.col("__rn"))})
    runs = rows.groupBy(*keys, "state", "run").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("length"),
        *[F.avg(m).alias(f"mean_{m}") for m in means],
    )
    return top_k(runs, [*keys, "state"], [F.desc("length"), F.col("run")], top).drop("run")


def argmax_rows(probs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most likely next state per row of the matrix; ties go to the lower state."""
    return probs.groupBy(*keys, "i").agg(F.max_by("j", F.struct("p", -F.col("j"))).alias("guess"))


def persistence_vs_markov(
    states: DataFrame, matrices: DataFrame, keys: Sequence[str], horizons: Sequence[int], k: int
) -> DataFrame:
    """Accuracy of 'same state again' and of the matrix's best guess h rows ahead."""
    keys = list(keys)

    def add(rows, w):
        parts = [F.struct(F.lit(h).alias("h"), F.lead("state", h).over(w).alias("actual")) for h in horizons]
        return rows.withColumn("__p", F.array(*parts))

    rows = row_frames(states, keys, ["ts"], add, ahead=max(horizons))
    pairs = rows.select(*keys, F.col("state").alias("i"), F.inline("__p")).filter("actual IS NOT NULL")
    guess = argmax_rows(multi_step(matrices, keys, horizons, k), [*keys, "h"])
    hit = lambda c: F.avg(F.when(F.col(c) == F.col("actual"), 1.0).otherwise(0.0))
    return (
        pairs.join(guess, [*keys, "h", "i"])
        .groupBy(*keys, "h")
        .agg(
            F.count(F.lit(1)).alias("n"), hit("i").alias("persistence_acc"), hit("guess").alias("markov_acc"),
            F.avg(F.when(F.col("guess") == F.col("i"), 1.0).otherwise(0.0)).alias("same_guess"),
        )
    )


def rolling_windows(rows: DataFrame, first: str, length_s: int, step_s: int) -> DataFrame:
    """Each row once per window it lies in; window w starts at ``first`` + w * step. A row meets length/step windows."""
    age = F.unix_seconds("ts") - F.unix_seconds(F.lit(first).cast("timestamp"))
    newest = F.floor(age / step_s)
    oldest = F.greatest(F.lit(0).cast("bigint"), F.floor((age - length_s) / step_s) + 1)
    return rows.filter(age >= 0).withColumn("window", F.explode(F.sequence(oldest, newest)))


def transition_drift(states: DataFrame, keys: Sequence[str], k: int, first: str, length_s: int, step_s: int) -> DataFrame:
    """How much each transition probability moves over rolling windows that are filled to their end.

    A transition belongs to a window when both its ends do. Rows are read once, into counts per pane, a stretch that
    window starts and ends are multiples of; windows are sums of panes, so what is repeated for overlapping windows is
    a few counts and no row.
    """
    keys = list(keys)

    def add(rows, w):
        return rows.withColumns({"nxt": F.lead("state").over(w), "nxt_ts": F.lead("ts").over(w)})

    pane_s = math.gcd(length_s, step_s)
    origin = F.unix_seconds(F.lit(first).cast("timestamp"))
    pane = lambda ts: F.floor((F.unix_seconds(ts) - origin) / pane_s)
    rows = row_frames(states, keys, ["ts"], add, ahead=1)
    panes = settle(
        rows.groupBy(*keys, pane("ts").alias("p0"), pane("nxt_ts").alias("p1"), F.col("state").alias("i"), F.col("nxt").alias("j"))
        .agg(F.count(F.lit(1)).alias("c"), F.max("ts").alias("last_ts")))
    spans = panes.groupBy(*keys).agg(F.max("last_ts").alias("last_ts"))
    age = F.col("p0") * pane_s
    oldest = F.greatest(F.lit(0).cast("bigint"), F.floor((age - length_s) / step_s) + 1)
    win = (
        panes.drop("last_ts").filter(age >= 0)
        .withColumn("window", F.explode(F.sequence(oldest, F.floor(age / step_s))))
        .join(spans, keys)
    )
    end = F.col("window") * step_s + length_s
    win = settle(win.filter(F.unix_seconds("last_ts") - origin >= end))
    n = (
        win.filter((F.col("p1") + 1) * pane_s <= end)
        .groupBy(*keys, "window", "i", "j")
        .agg(F.sum("c").alias("n"))
    )
    full = grid(win.select(*keys, "window").distinct(), k).join(n, [*keys, "window", "i", "j"], "left").na.fill(0, ["n"])
    p = transition_probs(full, [*keys, "window"], k)
    return (
        p.groupBy(*keys, "i", "j")
        .agg(
            F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max"),
            F.count(F.lit(1)).alias("windows"),
        )
        .withColumn("steady", F.col("std") < F.when(F.col("i") == F.col("j"), 0.03).otherwise(0.08))
    )


# -- state tables --------------------------------------------------------------------------------------------------


def state_signatures(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean of every feature per state, and the state's share of rows."""
    keys = list(keys)
    m = features.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in names])
    return m.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def canonical_labels(signatures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Four states: the two most volatile are STRESS and CRASH by return, the calm two UP and CHOP.

    Three states are named by return alone: DOWN, CHOP, UP.
    """
    w = Window.partitionBy(*keys)
    rows = signatures.withColumns(
        {
            "__k": F.count(F.lit(1)).over(w),
            "__v": F.row_number().over(w.orderBy(F.desc("realized_vol"), "state")),
            "__r": F.row_number().over(w.orderBy("log_return", "state")),
        }
    ).withColumn("__hot", F.col("__v") <= 2)
    pair = Window.partitionBy(*keys, "__hot").orderBy(F.desc("log_return"), "state")
    rows = rows.withColumn("__p", F.row_number().over(pair))
    four = ladder(
        (F.col("__hot") & (F.col("__p") == 1), "STRESS"), (F.col("__hot"), "CRASH"), (F.col("__p") == 1, "UP"), otherwise="CHOP"
    )
    three = F.element_at(F.array(F.lit("DOWN"), F.lit("CHOP"), F.lit("UP")), F.col("__r"))
    return rows.withColumn(
        "label", F.when(F.col("__k") == 4, four).when(F.col("__k") == 3, three)
    ).drop("__k", "__v", "__r", "__hot", "__p")


def k5_labels(signatures: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Suggested names for five states, and whether the weakest one looks like an artefact.

    Needs ``share`` and ``dwell``. The weakest state has the smallest largest mean.
    """
    v, r = F.col("realized_vol"), F.col("log_return")
    label = ladder(
        # fixed values: limits and labels
        ((v > 1) & (r > 0), "STRESS"), (v > 1, "CRASH"),
        ((v > 0) & (r < -0.005), "MID_BEAR"), ((v > 0) & (r <= 0.005), "MID_NEUTRAL"), (v > 0, "MID_BULL"),
        (F.abs(r) < 0.005, "CHOP"), (r > 0, "UP"), otherwise="DOWN",
    )
    top = F.greatest(*[F.abs(x) for x in names])
    w = Window.partitionBy(*keys).orderBy("max_mean", "state")
    # fixed values: what an artefact looks like
    bad = (F.col("max_mean") < 0.25) | (F.col("share") < 0.05) | (F.col("dwell") < 8)
    return signatures.withColumns({"label": label, "max_mean": top}).withColumns(
        {"weakest": F.row_number().over(w) == 1, "artefact": bad}
    )


def model_selection(models: DataFrame, keys: Sequence[str], d: int, base_k: int = 4) -> DataFrame:
    """BIC and AIC per number of states, the best one, and whether the five-state model holds a noise state."""
    k = F.col("k")
    params = (k - 1) + k * (k - 1) + 2 * k * d
    rows = models.withColumns(
        {
            "n_params": params,
            "bic": -2 * F.col("loglik") + params * F.log("n_obs"),
            "aic": -2 * F.col("loglik") + 2 * params,
        }
    )
    best = rows.groupBy(*keys).agg(
        F.min_by("k", F.struct("bic", "k")).alias("best_k"),
        F.bool_or((k == 5) & (F.col("weakest_mean") < 0.30)).alias("noise_state"),
    )
    return rows.join(best, list(keys)).withColumn("passes", (F.col("best_k") == base_k) & F.col("noise_state"))


# -- Gaussian hidden Markov models ---------------------------------------------------------------------------------

MODEL_SCHEMA = (
    "k int, seed int, n_obs bigint, loglik double, iterations int, first_ts timestamp, last_ts timestamp, "
    "start array<double>, trans array<array<double>>, means array<array<double>>, vars array<array<double>>, "
    "feature_mean array<double>, feature_std array<double>"
)


def _smooth(logb: np.ndarray, pi: np.ndarray, a: np.ndarray):
    """Scaled forward-backward over R models at once: (R,T,K), (R,K), (R,K,K) -> loglik, posteriors, pair sums."""
    r, t, k = logb.shape
    top = logb.max(-1, keepdims=True)
    b = np.exp(logb - top)
    al, be, sc = np.empty((r, t, k)), np.ones((r, t, k)), np.empty((r, t))
    f = pi * b[:, 0]
    for i in range(t):
        if i:
            f = np.matmul(al[:, i - 1, None, :], a)[:, 0] * b[:, i]
        sc[:, i] = np.maximum(f.sum(-1), 1e-300)
        al[:, i] = f / sc[:, i, None]
    for i in range(t - 2, -1, -1):
        be[:, i] = np.matmul(a, (b[:, i + 1] * be[:, i + 1])[..., None])[..., 0] / sc[:, i + 1, None]
    post = al * be
    nxt = b[:, 1:] * be[:, 1:] / sc[:, 1:, None]
    pairs = a * np.matmul(al[:, :-1].transpose(0, 2, 1), nxt)
    return np.log(sc).sum(1) + top[..., 0].sum(1), post, pairs


def _seed_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Starting means: spread-out points, then a few rounds of moving each to the mean of its nearest rows."""
    c = x[rng.integers(len(x))][None]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1) + 1e-12
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
    return c


def _em(x: np.ndarray, k: int, seeds: Sequence[int], n_iter: int, tol: float, floor: float = 1e-3):
    """EM for several random starts side by side; every start keeps its last parameters."""
    t, d = x.shape
    r = len(seeds)
    mu, pi, a = np.empty((r, k, d)), np.full((r, k), 1 / k), np.full((r, k, k), 1 / k)
    for s, seed in enumerate(seeds):
        rng = np.random.default_rng(seed)
        mu[s] = _seed_means(x, k, rng)
        a[s] = 0.8 * np.eye(k) + 0.2 * rng.dirichlet(np.ones(k), k)
        a[s] /= a[s].sum(1, keepdims=True)
    var = np.tile(x.var(0) + floor, (r, k, 1))
    xb = np.broadcast_to(x, (r, t, d))
    last, used = np.full(r, -np.inf), np.zeros(r, int)
    for _ in range(n_iter):
        ll, post, pairs = _smooth(emit(xb, mu, var), pi, a)
        live = np.abs(ll - last) > tol
        if not live.any():
            break
        used[live] += 1
        last = np.where(live, ll, last)
        w = post.sum(1) + 1e-12
        m = np.matmul(post.transpose(0, 2, 1), xb) / w[..., None]
        v = np.maximum(np.matmul(post.transpose(0, 2, 1), xb * xb) / w[..., None] - m * m, floor)
        p = (pairs + 1e-12) / (pairs + 1e-12).sum(-1, keepdims=True)
        on = live[:, None]
        pi = np.where(on, post[:, 0] / post[:, 0].sum(-1, keepdims=True), pi)
        mu, var = np.where(on[..., None], m, mu), np.where(on[..., None], v, var)
        a = np.where(on[..., None], p, a)
    ll, _, _ = _smooth(emit(xb, mu, var), pi, a)
    return ll, used, pi, a, mu, var


def hmm_fit_grid(
    features: DataFrame, keys: Sequence[str], names: Sequence[str], ks: Sequence[int], seeds: Sequence[int],
    n_iter: int = 200, tol: float = 1e-4, min_rows: int = 1000, months: int | None = 18,
) -> DataFrame:
    """Model table: one row per key, number of states and seed.

    Each key is fitted on its newest ``months``, so a group is never longer than that window (18 months of 4h bars:
    3,285 rows); with None on all its rows, for callers that have cut them to a window already. Windows, keys and state counts fit in parallel, restarts of one group side by side in numpy. Training
    rows are standardized by their own mean and sample deviation.
    """
    keys, names, seeds = list(keys), list(names), list(seeds)
    if months is not None:
        newest = features.groupBy(*keys).agg(F.max("ts").alias("__last"))
        features = features.join(newest, keys).filter(F.col("ts") >= F.add_months("__last", -months)).drop("__last")
    grid_rows = features.select(*keys, "ts", *names).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    fields = [f for f in features.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: keys.index(f.name)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        k = int(pdf["k"].iloc[0])
        if len(pdf) < max(min_rows, k + 1):
            return pd.DataFrame(columns=[*keys, *[c.split()[0] for c in MODEL_SCHEMA.split(", ")]])
        raw = pdf[names].to_numpy(float)
        mean, std = raw.mean(0), raw.std(0, ddof=1)
        std[std == 0] = 1.0
        ll, used, pi, a, mu, var = _em((raw - mean) / std, k, seeds, n_iter, tol)
        rows = [
            [*[pdf[c].iloc[0] for c in keys], k, s, len(pdf), float(ll[i]), int(used[i]), pdf["ts"].iloc[0],
             pdf["ts"].iloc[-1], pi[i].tolist(), a[i].tolist(), mu[i].tolist(), var[i].tolist(), mean.tolist(), std.tolist()]
            for i, s in enumerate(seeds)
        ]
        return pd.DataFrame(rows, columns=[*keys, *[c.split()[0] for c in MODEL_SCHEMA.split(", ")]])

    # a fixed partition count: the groups are few and heavy, and adaptive coalescing would put them into one task
    parts = 4 * features.sparkSession.sparkContext.defaultParallelism
    return grid_rows.repartition(parts, *keys, "k").groupBy(*keys, "k").applyInPandas(fit, f"{schema}, {MODEL_SCHEMA}")


def best_models(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most likely restart per key and number of states."""
    rest = [c for c in models.columns if c not in keys]
    top = models.filter("NOT isnan(loglik)").groupBy(*keys, F.col("k").alias("__k")).agg(
        F.max_by(F.struct(*rest), F.struct("loglik", -F.col("seed"))).alias("m")
    )
    return top.select(*keys, "m.*")


def hmm_rolling(
    features: DataFrame, keys: Sequence[str], names: Sequence[str], k: int, seeds: Sequence[int], first: str,
    length_s: int, step_s: int, min_rows: int = 1000,
) -> DataFrame:
    """Best model per key and rolling window, fitted on all its rows; only windows the key's data fills to the end."""
    spans = features.groupBy(*keys).agg(F.max("ts").alias("__last"))
    end = F.unix_seconds(F.lit(first).cast("timestamp")) + F.col("window") * step_s + length_s
    rows = rolling_windows(features, first, length_s, step_s).join(spans, list(keys))
    rows = rows.filter(F.unix_seconds("__last") >= end).drop("__last")
    return best_models(hmm_fit_grid(rows, [*keys, "window"], names, [k], seeds, min_rows=min_rows, months=None), [*keys, "window"])


def current_regime(decoded: DataFrame, models: DataFrame, keys: Sequence[str], k: int, horizons=(1, 6, 24, 48)) -> DataFrame:
    """The newest bar's state with expected dwell and the chain's forecast (one array of probabilities per horizon)."""
    keys = list(keys)
    now = decoded.groupBy(*keys).agg(
        F.max_by(F.struct("ts", "smoothed", "confidence", "entropy", "posterior"), "ts").alias("x")
    )
    rows = now.join(models.select(*keys, F.col("trans").alias("m"), "last_ts", "n_obs"), keys).select(*keys, "x.*", "m", "last_ts", "n_obs")
    s = F.col("smoothed")
    stay = F.get(F.get("m", s), s)
    return rows.withColumns(
        {
            "dwell": 1 / F.greatest(F.lit(1e-9), 1 - stay),
            **{f"forecast_{h}": F.get(matpow("m", h, k), s) for h in horizons},
        }
    ).drop("m")


def model_states(models: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The model table's state means as one row per state, one column per feature."""
    rows = models.select(*keys, "k", "seed", "loglik", F.posexplode("means").alias("state", "__m"))
    return rows.select(*keys, "k", "seed", "loglik", "state", *[F.get("__m", F.lit(i)).alias(n) for i, n in enumerate(names)])


def seed_stability(models: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Do restarts agree? Share within 5% of the best likelihood and the largest spread of a labelled state's means."""
    keys = list(keys)
    w = Window.partitionBy(*keys)  # one row per seed
    best = models.withColumn("__b", F.max("loglik").over(w))
    near = best.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), F.max("loglik").alias("best"), F.min("loglik").alias("worst"),
        # fixed value: how near the best likelihood counts as equal
        F.avg(F.when(F.abs(F.col("loglik") - F.col("__b")) / F.abs("__b") < 0.05, 1.0).otherwise(0.0)).alias("near_best"),
    )
    labelled = canonical_labels(model_states(models, keys, names), [*keys, "seed"])
    spread = labelled.groupBy(*keys, "label").agg(F.greatest(*[F.stddev_pop(n) for n in names]).alias("s"))
    worst = spread.groupBy(*keys).agg(F.max("s").alias("max_std"), F.count(F.lit(1)).alias("labels"))
    return near.join(worst, keys).withColumn("passes", (F.col("near_best") >= 0.80) & (F.col("max_std") < 0.30))
