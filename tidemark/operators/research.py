"""Offline research: return distributions, score validation and event studies, per key and horizon."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import correlation, div, ladder, log_ratio, sign
from ..plans.ordered import asof_join, grid_asof_join, numbered, row_frames
from ..plans.settle import settle
from ..plans.ranks import exact_quantiles, spearman
from .indicators import (
    TRIGGER_ZONES, Stoch, add_ret, add_stoch, add_vwap, band_position, cross, dedup_triggers, last_n, rv,
    stoch_reach,
)


# -- return distributions ------------------------------------------------------------------------------------------


def horizon_returns(bars: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Long form: one row per bar and horizon ``h`` with its log return ``r``; ``i`` counts the returns from 0."""

    def add(rows, w):
        parts = [
            F.struct(F.lit(h).alias("h"), log_ratio("close", F.lag("close", h).over(w)).alias("r")) for h in horizons
        ]
        return rows.withColumn("__p", F.array(*parts))

    rows = row_frames(bars, keys, ["ts"], add, back=max(horizons), keep_number=True)
    return (
        rows.select(*keys, "ts", "__rn", F.inline("__p"))
        .filter("r IS NOT NULL")
        .withColumn("i", F.col("__rn") - 1 - F.col("h"))
        .drop("__rn")
    )


def moments(rets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean in basis points, population deviation, skewness and excess kurtosis, extremes in percent."""
    return rets.groupBy(*keys, "h").agg(
        F.count("r").alias("n"), (F.avg("r") * 1e4).alias("mean_bp"), (F.stddev_pop("r") * 100).alias("std_pct"),
        F.skewness("r").alias("skew"), F.kurtosis("r").alias("exkurt"),
        (F.min("r") * 100).alias("min_pct"), (F.max("r") * 100).alias("max_pct"),
    )


def jarque_bera(m: DataFrame) -> DataFrame:
    """Normality test from the moments; with two degrees of freedom the tail is exp(-JB/2)."""
    jb = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("exkurt", F.lit(2)) / 4)
    return m.withColumn("jb", jb).withColumn("p", F.exp(-F.col("jb") / 2)).withColumn("rejected", F.col("p") < 0.01)


# Two-sided normal tail probabilities beyond 3, 4 and 5 deviations.
NORMAL_TAILS = {3: 0.0026997960632601866, 4: 6.334248366623973e-05, 5: 5.733031437583869e-07}


def tail_freq(rets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed against normal frequency of extreme returns, and left against right tail."""
    by = [*keys, "h"]
    stats = rets.groupBy(*by).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    z = rets.join(stats, by).withColumn("z", div(F.col("r") - F.col("m"), "s"))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    out = z.groupBy(*by).agg(
        F.count("z").alias("n"), *[share(F.abs("z") > k).alias(f"obs_{k}") for k in NORMAL_TAILS],
        share(F.col("z") < -3).alias("left_3"), share(F.col("z") > 3).alias("right_3"),
    )
    return out.withColumns(
        {**{f"ratio_{k}": F.col(f"obs_{k}") / p for k, p in NORMAL_TAILS.items()}, "left_right": div("left_3", "right_3")}
    )


def autocorr(bars: DataFrame, keys: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Autocorrelation of returns and of their size at several lags, long form."""
    keys = list(keys)

    def add(rows, w):
        rows = add_ret(rows, w)
        parts = [F.struct(F.lit(k).alias("lag"), F.lag("ret", k).over(w).alias("past")) for k in lags]
        return rows.withColumn("__p", F.array(*parts))

    rows = row_frames(bars, keys, ["ts"], add, back=max(lags) + 1)
    pairs = rows.select(*keys, "ret", F.inline("__p")).filter("past IS NOT NULL AND ret IS NOT NULL")
    return pairs.groupBy(*keys, "lag").agg(
        correlation("ret", "past").alias("acf"), correlation(F.abs("ret"), F.abs("past")).alias("acf_abs"), F.count(F.lit(1)).alias("n")
    )


def autocorr_blocks(bars: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Lag-1 autocorrelation of h-bar returns that do not overlap, with a reading."""
    keys = list(keys)

    def add(rows, w):
        parts = []
        for h in horizons:
            r = lambda k, h=h: log_ratio(F.lag("close", k).over(w), F.lag("close", k + h).over(w))
            parts.append(
                F.when(
                    (F.col("__rn") - 1 - h) % h == 0,
                    F.struct(F.lit(h).alias("h"), r(0).alias("r"), r(h).alias("past")),
                )
            )
        return rows.withColumn("__p", F.array_compact(F.array(*parts)))

    rows = row_frames(bars, keys, ["ts"], add, back=2 * max(horizons))
    a = F.col("acf1")
    return (
        rows.select(*keys, F.inline("__p"))
        .filter("r IS NOT NULL")
        .groupBy(*keys, "h")
        .agg(correlation("r", "past").alias("acf1"), F.count("r").alias("n"))
        .withColumn("reading", ladder((a < -0.03, "mean-reversion"), (a > 0.03, "momentum"), (a.isNotNull(), "random walk")))
    )


def regime_moments(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribution of the next bar's return by state; needs ten rows."""

    def add(rows, w):
        return rows.withColumn("nxt", F.lead("ret").over(w))

    rows = row_frames(states, keys, ["ts"], add, ahead=1).filter("nxt IS NOT NULL")
    return (
        rows.groupBy(*keys, "state")
        .agg(
            F.count("nxt").alias("n"), (F.avg("nxt") * 1e4).alias("mean_bp"), (F.stddev_pop("nxt") * 100).alias("std_pct"),
            F.skewness("nxt").alias("skew"), F.kurtosis("nxt").alias("exkurt"),
            (F.count_if(F.col("nxt") > 0) / F.count("nxt") * 100).alias("p_up"),
        )
        .filter("n >= 10")
    )


CUTS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def magnitude_calibration(
    rets: DataFrame, states: DataFrame, keys: Sequence[str], min_n: int = 50
) -> DataFrame:
    """Percentiles of |return| per horizon and state, and over all states (state ALL).

    ``std_abs_ret`` is the population deviation of the absolute returns.
    """
    by = [*keys, "h", "state"]
    labelled = rets.join(states.select(*keys, "ts", F.col("state").cast("string").alias("s")), [*keys, "ts"])
    rows = labelled.select(
        *keys, "h", F.abs("r").alias("a"), F.explode(F.array(F.col("s"), F.lit("ALL"))).alias("state")
    )
    rows = settle(rows)
    q = exact_quantiles(rows, by, "a", CUTS)
    std = rows.groupBy(*by).agg(F.stddev_pop("a").alias("std_abs_ret"))
    return q.join(std, by).filter(F.col("n") >= min_n)


def gaussian_mispricing(cal: DataFrame) -> DataFrame:
    """How many deviations the empirical 99th percentile lies out, against the normal rule's 2.58."""
    s = F.when(F.col("std_abs_ret") > 0, F.col("p99") / F.col("std_abs_ret"))
    return cal.withColumn("p99_sigma", s).withColumns(
        {"gap": F.col("p99_sigma") - 2.58, "too_often": F.col("p99_sigma") > 2.8}
    )


def with_cuts(moves: DataFrame, cal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each move beside its state's cuts, or the cuts of ALL where the state has none.

    The calibration has one row per key, horizon and state; Spark broadcasts it when it is small.
    """
    cuts = cal.select(*keys, "h", F.col("state").alias("__s"), F.struct(*CUTS).alias("own"))
    every = cal.filter("state = 'ALL'").select(*keys, "h", F.struct(*CUTS).alias("every"))
    rows = moves.withColumn("__s", F.col("state").cast("string"))
    out = rows.join(cuts, [*keys, "h", "__s"], "left").join(every, [*keys, "h"], "left")
    return out.withColumns(
        {
            "cuts": F.coalesce("own", "every"),
            "regime_used": F.when(F.col("own").isNotNull(), F.col("__s")).when(F.col("every").isNotNull(), "ALL"),
        }
    ).drop("own", "every", "__s")


def magnitude_label(moves: DataFrame) -> DataFrame:
    """Label and interpolated percentile of ``a`` (an absolute move) against ``cuts``."""
    a = F.col("a")
    at = lambda p: F.col(f"cuts.{p}")
    knots: list[tuple[Column, int]] = [(F.lit(0.0), 0)]
    knots += [(at(p), int(round(q * 100))) for p, q in CUTS.items()]
    knots.append((at("p99") * 2, 100))
    steps = []
    for (lo, lo_p), (hi, hi_p) in zip(knots, knots[1:]):
        share = F.coalesce(F.when(hi > lo, (a - lo) / (hi - lo)), F.lit(0.0))
        steps.append((a <= hi, lo_p + (hi_p - lo_p) * share))
    return moves.filter("cuts IS NOT NULL").withColumns(
        {
            "label": ladder(
                (a >= at("p99"), "EXTREME"), (a >= at("p90"), "ELEVATED"), (a >= at("p50"), "NORMAL"), otherwise="NOISE"
            ),
            "percentile": ladder(*steps, otherwise=F.lit(100.0)),
        }
    )


# -- score validation ----------------------------------------------------------------------------------------------


def attach_returns(
    log: DataFrame, bars: DataFrame, keys: Sequence[str], hours: Sequence[int], bar_seconds: int = 3600,
) -> DataFrame:
    """For every log row the simple return from the close at its time to the close h hours on (negative h: back).

    Bars start on a grid of ``bar_seconds``. The closes of all target times of a bar are looked up once per bar slot of the
    log, not once per log row; rows then meet their slot by equality, so a hot key is neither sorted nor regrouped.
    """
    keys = list(keys)
    offsets = sorted({0, *hours})
    rows = log.filter("ts IS NOT NULL").withColumn("__slot", F.floor(F.unix_seconds("ts") / F.lit(bar_seconds)))
    if any(h * 3600 % bar_seconds for h in offsets):
        raise ValueError("offsets must be whole bars")
    slots = rows.select(*keys, "__slot").distinct().withColumn("h", F.explode(F.array(*[F.lit(h) for h in offsets])))
    slots = slots.withColumn("__t", F.timestamp_seconds(F.col("__slot") * bar_seconds + F.col("h") * 3600))
    found = grid_asof_join(slots, bars.select(*keys, "ts", "close"), keys, ["close"], bar_seconds, left_ts="__t")
    closes = found.groupBy(*keys, "__slot").agg(
        *[F.max(F.when(F.col("h") == h, F.col("close"))).alias(f"c_{i}") for i, h in enumerate(offsets)]
    )
    wide = rows.join(closes, [*keys, "__slot"], "left").drop("__slot")
    base = F.col(f"c_{offsets.index(0)}")
    out = {}
    for i, h in enumerate(offsets):
        if h > 0:
            out[f"ret_{h}h"] = F.when(base > 0, F.col(f"c_{i}") / base - 1)
        elif h < 0:
            out[f"prev_{-h}h"] = F.when(F.col(f"c_{i}") > 0, base / F.col(f"c_{i}") - 1)
    return wide.withColumns(out).drop(*[f"c_{i}" for i in range(len(offsets))])


def by_horizon(rows: DataFrame, keep: Sequence[str], hours: Sequence[int]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}h").alias("ret")) for h in hours])
    return rows.select(*keep, F.inline(parts)).filter("ret IS NOT NULL")


def rank_ic(long: DataFrame, keys: Sequence[str], score: str = "score", invert: bool = False) -> DataFrame:
    """Spearman correlation of score and forward return per horizon; needs ten pairs."""
    rows = long.withColumn("__x", -F.col(score) if invert else F.col(score))
    return spearman(rows, [*keys, "h"], "__x", "ret")


# Score sizes that are judged together.
SCORE_BINS = [(1, 1), (2, 2), (3, 4), (5, 7), (8, 10)]


def sign_accuracy(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows whose score has the sign of the return: overall (bin ALL) and by size, with a rising flag.

    The flag looks at bins with five rows or more: does accuracy never fall as the score grows?
    """
    by = [*keys, "h"]
    a = F.abs("score")
    size = ladder(*[((a >= lo) & (a <= hi), f"{lo}-{hi}") for lo, hi in SCORE_BINS])
    order = ladder(*[(F.col("bin") == f"{lo}-{hi}", i) for i, (lo, hi) in enumerate(SCORE_BINS)])
    rows = long.filter("score <> 0 AND ret <> 0").withColumn("bin", F.explode(F.array(size, F.lit("ALL"))))
    hit = F.when(sign("score") == sign("ret"), 1.0).otherwise(0.0)
    acc = rows.filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    w = Window.partitionBy(*by).orderBy("__o")  # five rows per key and horizon
    judged = acc.withColumn("__o", order).filter("__o IS NOT NULL AND n >= 5").withColumn(
        "__fall", F.col("accuracy") < F.lag("accuracy").over(w)
    )
    flag = judged.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) >= 2, ~F.coalesce(F.bool_or("__fall"), F.lit(False))).alias("rising")
    )
    return acc.join(flag, by, "left")


def baseline_lift(rows: DataFrame, keys: Sequence[str], hours: Sequence[int]) -> DataFrame:
    """Accuracy of the score's sign minus that of the last hour's return sign, on the same rows."""
    long = by_horizon(rows, [*keys, "score", "prev_1h"], hours).filter("score <> 0 AND ret <> 0 AND prev_1h <> 0")
    hit = lambda c: F.avg(F.when(sign(c) == sign("ret"), 1.0).otherwise(0.0))
    return (
        long.groupBy(*keys, "h")
        .agg(F.count(F.lit(1)).alias("n"), hit("score").alias("score_acc"), hit("prev_1h").alias("base_acc"))
        .withColumn("lift_pp", (F.col("score_acc") - F.col("base_acc")) * 100)
    )


def issuance_lead_ic(daily: DataFrame, close: DataFrame, keys: Sequence[str], days: Sequence[int], roll: int = 7) -> DataFrame:
    """Does net issuance lead price? Rank correlation, per price series, of daily and rolling net flow with returns ahead.

    ``daily``: day, net; ``close``: keys, day, close. One row per day: a calendar bounds both. Needs twenty days.
    """
    keys = list(keys)

    def fwd(rows, w):
        return rows.withColumns({f"ret_{n}h": div(F.lead("close", n).over(w), "close") - 1 for n in days})

    def rolled(rows, w):
        return rows.withColumn("net_roll", F.when(F.col("__rn") >= roll, F.sum("net").over(last_n(w, roll))))

    ahead = row_frames(close.select(*keys, "day", "close"), keys, ["day"], fwd, ahead=max(days))
    net = row_frames(daily.select("day", "net").withColumn("series", F.lit("all")), ["series"], ["day"], rolled, back=roll)
    both = net.join(ahead, "day")
    parts = F.array(
        F.struct(F.lit("daily").alias("kind"), F.col("net").alias("x")),
        F.struct(F.lit("rolling").alias("kind"), F.col("net_roll").alias("x")),
    )
    rows = both.select(*keys, F.inline(parts), *[f"ret_{n}h" for n in days])
    return spearman(by_horizon(rows, [*keys, "kind", "x"], days), [*keys, "kind", "h"], "x", "ret", 20)


# -- event study ---------------------------------------------------------------------------------------------------

FACTORS = ["funding", "taker", "ethbtc", "vp"]


def factor_signs() -> dict[str, Column]:
    """+1 where a factor leans bullish, -1 bearish, 0 neutral or unknown."""
    r, t, e, pos = F.col("rate"), F.col("taker_ratio"), F.col("ethbtc_chg"), F.col("position")
    zero = F.lit(0)
    return {
        "s_funding": ladder((r > 0.0001, -1), (r < -0.0001, 1), otherwise=zero),
        "s_taker": ladder((t > 1.05, 1), ((t > 0) & (t < 1 / 1.05), -1), otherwise=zero),
        "s_ethbtc": ladder((e > 2, 1), (e < -2, -1), otherwise=zero),
        "s_vp": ladder((pos == "above_va", -1), (pos == "below_va", 1), otherwise=zero),
    }


def middle(values: Column) -> Column:
    """The median of an array of numbers, halfway between the two in the middle if there are two; null if it is empty."""
    v, n = F.sort_array(values), F.size(values)
    lower, upper = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return lower + (upper - lower) * 0.5


def factor_inputs(
    bars: DataFrame, funding: DataFrame, bench: DataFrame, keys: Sequence[str], slow: Stoch, fast: Stoch,
    horizons: Sequence[int] = (1,), day: int = 24, med: int = 90,
) -> DataFrame:
    """Everything an event study reads at a bar, in one framed pass; numbers kept."""
    x = asof_join(numbered(bars, keys, ["ts"]), [(funding, ["rate"]), (bench, ["btc"])], [])
    sell = F.col("volume") - F.col("taker_buy_base")
    x = x.withColumns(
        {
            "taker_ratio": F.when(sell > 0, F.col("taker_buy_base") / sell),
            "imbalance": div(2 * F.col("taker_buy_base") - F.col("volume"), "volume"),
            "__rel": div("close", "btc"),
        }
    )

    def add(rows, w):
        rows = add_stoch(rows, w, slow, "slow_k", "slow_d")
        rows = add_stoch(rows, w, fast, "fast_k", "fast_d")
        rows = add_ret(add_vwap(rows, w, day), w)
        short, long = rv(w, 2, 1.0), rv(w, 24, 1.0)
        # the window only gathers the volumes; their median is a projection, which Spark evaluates after later filters,
        # so that it is sorted out for the few rows that are events and not for every bar
        half = middle(F.collect_list("volume").over(last_n(w, med)))
        return rows.withColumns(
            {
                "vol_ratio": F.when(long > 0, short / long),
                "fast_k_1": F.lag("fast_k").over(w),
                "fast_d_1": F.lag("fast_d").over(w),
                "ethbtc_chg": (div(F.col("__rel"), F.lag("__rel", day).over(w)) - 1) * 100,
                "vol_rel": F.when((F.col("__rn") >= med) & (half > 0), F.col("volume") / half),
                **{f"fwd_{h}": div(F.lead("close", h).over(w), "close") - 1 for h in horizons},
            }
        )

    reach = max(stoch_reach([slow, fast]) + 1, day, med)
    rows = row_frames(x, keys, ["ts"], add, back=reach, ahead=max(horizons), keep_number=True)
    return rows.withColumn("position", band_position())


def trigger_events(inputs: DataFrame, keys: Sequence[str], gap: int, horizons: Sequence[int]) -> DataFrame:
    """Thinned reversal triggers with factor signs and returns in the trade's direction (``r_h``)."""
    x = cross("fast_k", "fast_d", "fast_k_1", "fast_d_1")
    fk, sk, z = F.col("fast_k"), F.col("slow_k"), TRIGGER_ZONES
    side = ladder(
        ((x == "up") & (fk < z["long_fast_below"]) & (sk < z["long_slow_below"]), "long"),
        ((x == "down") & (fk > z["short_fast_above"]) & (sk > z["short_slow_above"]), "short"),
    )
    rows = inputs.withColumn("side", F.when(sk.isNotNull(), side)).filter("side IS NOT NULL").withColumn(
        "pos", F.col("__rn") - 1
    )
    kept = dedup_triggers(rows.drop("__rn", "__n"), keys, gap)
    d = F.when(F.col("side") == "long", 1).otherwise(-1)
    return kept.withColumns(
        {**factor_signs(), "dir": d, **{f"r_{h}": F.col(f"fwd_{h}") * d for h in horizons}}
    ).withColumn("n_confirm", sum((F.col(f"s_{f}") == F.col("dir")).cast("int") for f in FACTORS))


def _hit(r: Column) -> Column:
    return F.avg(F.when(r > 0, 1.0).otherwise(0.0))


def event_baseline(events: DataFrame, horizons: Sequence[int]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r_{h}").alias("r")) for h in horizons])
    rows = events.select("side", F.inline(parts)).filter("r IS NOT NULL")
    r, long = F.col("r"), F.col("side") == "long"
    stats = rows.groupBy("h").agg(
        F.avg("r").alias("mean"), _hit(r).alias("hit"),
        F.avg(F.when(long, F.when(r > 0, 1.0).otherwise(0.0))).alias("long_hit"),
        F.avg(F.when(~long, F.when(r > 0, 1.0).otherwise(0.0))).alias("short_hit"),
    )
    return exact_quantiles(rows, ["h"], "r", {"median": 0.5}).join(stats, "h")


def event_attribution(events: DataFrame, h: int) -> DataFrame:
    """Mean return when a factor confirms the trade against when it contradicts it."""
    parts = F.array(*[F.struct(F.lit(f).alias("factor"), (F.col(f"s_{f}") * F.col("dir")).alias("rel")) for f in FACTORS])
    rows = events.filter(F.col(f"r_{h}").isNotNull()).select(F.col(f"r_{h}").alias("r"), F.inline(parts))
    yes, no = F.col("rel") == 1, F.col("rel") == -1
    return rows.groupBy("factor").agg(
        F.count_if(yes).alias("confirm_n"), (F.avg(F.when(yes, F.col("r"))) * 100).alias("confirm_ret"),
        F.count_if(no).alias("contra_n"), (F.avg(F.when(no, F.col("r"))) * 100).alias("contra_ret"),
    ).withColumn("edge_pp", F.col("confirm_ret") - F.col("contra_ret"))


def event_confluence(events: DataFrame, h: int) -> DataFrame:
    r = F.col(f"r_{h}")
    return events.filter(r.isNotNull()).groupBy("n_confirm").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(r) * 100).alias("mean_ret"), (_hit(r) * 100).alias("hit_pct")
    )


# Bucket names with their lower bounds.
VOL_BUCKETS = [("low <0.8", 0.0), ("normal 0.8-1.5", 0.8), ("high 1.5-3", 1.5), ("climax >3", 3.0)]
IMB_BUCKETS = [("aligned <0", -math.inf), ("mild 0-0.03", 0.0), ("strong 0.03-0.06", 0.03), ("extreme >0.06", 0.06)]


def event_volume_buckets(events: DataFrame, h: int) -> DataFrame:
    """Outcome by volume against its 90-bar median and by flow still pushing against the trade."""
    r = F.col(f"r_{h}")
    named = lambda x, bs: F.when(x.isNotNull(), ladder(*[(x >= lo, n) for n, lo in reversed(bs)]))
    parts = F.array(
        F.struct(F.lit("volume").alias("view"), named(F.col("vol_rel"), VOL_BUCKETS).alias("bucket")),
        F.struct(F.lit("imbalance").alias("view"), named(-F.col("imbalance") * F.col("dir"), IMB_BUCKETS).alias("bucket")),
    )
    rows = events.filter(r.isNotNull()).select(r.alias("r"), F.inline(parts)).filter("bucket IS NOT NULL")
    return rows.groupBy("view", "bucket").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("r") * 100).alias("mean_ret"), (_hit(F.col("r")) * 100).alias("hit_pct")
    )
