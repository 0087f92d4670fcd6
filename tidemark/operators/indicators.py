"""Indicators over ordered bars. Each operator makes one ``row_frames`` pass and stacks its frames inside it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import div, ladder, log_ratio
from ..plans.ordered import asof_join, full, numbered, row_frames, running_last
from ..plans.settle import settle

HOURS_PER_YEAR = 24 * 365
ANNUAL = math.sqrt(HOURS_PER_YEAR) * 100


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def prior_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


# -- stochastics -----------------------------------------------------------------------------------------------

Stoch = tuple[int, int, int]


def stoch_reach(params: Sequence[Stoch]) -> int:
    return max(sum(p) - 3 for p in params)


def add_stoch(rows: DataFrame, w: WindowSpec, params: Stoch, k_name: str, d_name: str) -> DataFrame:
    """Smoothed %K and %D; null until every stacked window is full, 50 where the range is flat."""
    k, ks, ds = params
    hi, lo = F.max("high").over(last_n(w, k)), F.min("low").over(last_n(w, k))
    raw = F.when(hi == lo, 50.0).otherwise((F.col("close") - lo) / (hi - lo) * 100)
    return (
        rows.withColumn("__raw", full(w, k, raw))
        .withColumn(k_name, full(w, k + ks - 1, F.avg("__raw").over(last_n(w, ks))))
        .withColumn(d_name, full(w, k + ks + ds - 2, F.avg(k_name).over(last_n(w, ds))))
        .drop("__raw")
    )


LIVE = {"slow": (400, 40, 10), "fast": (100, 10, 4)}
RESEARCH = {"slow": (400, 10, 40), "fast": (100, 4, 10)}


def stochastics(
    bars: DataFrame, keys: Sequence[str], slow: Stoch, fast: Stoch, keep_number: bool = False, lags: int = 0
) -> DataFrame:
    """``slow_k slow_d fast_k fast_d`` and, for ``lags`` > 0, the previous fast values as ``fast_k_1`` ..."""

    def add(rows, w):
        rows = add_stoch(rows, w, slow, "slow_k", "slow_d")
        rows = add_stoch(rows, w, fast, "fast_k", "fast_d")
        for i in range(1, lags + 1):
            rows = rows.withColumn(f"fast_k_{i}", F.lag("fast_k", i).over(w)).withColumn(
                f"fast_d_{i}", F.lag("fast_d", i).over(w)
            )
        return rows

    return row_frames(
        bars, keys, ["ts"], add, back=stoch_reach([slow, fast]) + lags, keep_number=keep_number
    )


def cross(k, d, k_prev, d_prev) -> Column:
    k, d, kp, dp = (F.col(x) for x in (k, d, k_prev, d_prev))
    return ladder(((kp <= dp) & (k > d), "up"), ((kp >= dp) & (k < d), "down"))


def cross_detect(bars: DataFrame, keys: Sequence[str], slow: Stoch, fast: Stoch) -> DataFrame:
    rows = stochastics(bars, keys, slow, fast, lags=1)
    return rows.withColumn("turn", cross("fast_k", "fast_d", "fast_k_1", "fast_d_1")).filter("turn IS NOT NULL")


# Zones in which a fast cross counts as a reversal trigger.
TRIGGER_ZONES = {"long_fast_below": 30, "long_slow_below": 40, "short_fast_above": 70, "short_slow_above": 60}


def stoch_triggers(bars: DataFrame, keys: Sequence[str], slow: Stoch, fast: Stoch, zones=TRIGGER_ZONES) -> DataFrame:
    """Reversal triggers: ``pos`` (0-based bar number) and ``side``."""
    rows = stochastics(bars, keys, slow, fast, keep_number=True, lags=1)
    x = cross("fast_k", "fast_d", "fast_k_1", "fast_d_1")
    fk, sk = F.col("fast_k"), F.col("slow_k")
    side = ladder(
        ((x == "up") & (fk < zones["long_fast_below"]) & (sk < zones["long_slow_below"]), "long"),
        ((x == "down") & (fk > zones["short_fast_above"]) & (sk > zones["short_slow_above"]), "short"),
    )
    return (
        rows.withColumn("side", F.when(F.col("slow_k").isNotNull(), side))
        .filter(F.col("side").isNotNull())
        .withColumn("pos", F.col("__rn") - 1)
        .drop("__rn", "__n")
    )


# -- volatility ------------------------------------------------------------------------------------------------


def add_ret(rows: DataFrame, w: WindowSpec) -> DataFrame:
    prev = F.lag("close").over(w)
    return rows.withColumn("ret", log_ratio("close", prev))


def rv(w: WindowSpec, n: int, annual: float = ANNUAL) -> Column:
    """Sample deviation of the last n returns (the first bar has none)."""
    return full(w, n + 1, F.stddev_samp("ret").over(last_n(w, n)) * annual)


def realized_vol(bars: DataFrame, keys: Sequence[str], windows: Sequence[int] = (4, 24, 168)) -> DataFrame:
    """``rv_n`` in annual percent, and ``rv_ratio`` = shortest over second window."""
    a, b = windows[0], windows[1]

    def add(rows, w):
        rows = add_ret(rows, w)
        rows = rows.withColumns({f"rv_{n}": rv(w, n) for n in windows})
        return rows.withColumn("rv_ratio", div(f"rv_{a}", f"rv_{b}"))

    return row_frames(bars, keys, ["ts"], add, back=max(windows) + 1)


def rv_history(bars: DataFrame, keys: Sequence[str], n: int = 24, last: int = 60) -> DataFrame:
    """The last 60 rolling volatilities of a key."""

    def add(rows, w):
        return add_ret(rows, w).withColumn("rv", rv(w, n))

    rows = row_frames(bars, keys, ["ts"], add, back=n + 1, keep_number=True)
    return rows.filter((F.col("__n") - F.col("__rn") < last) & F.col("rv").isNotNull()).drop("__rn", "__n")


def vol_percentile(bars: DataFrame, keys: Sequence[str], n: int = 24, min_days: int = 5) -> DataFrame:
    """Latest volatility against non-overlapping past ones: share at or below it in percent, and a label."""
    keys = list(keys)

    def add(rows, w):
        return add_ret(rows, w)

    rets = row_frames(bars, keys, ["ts"], add, back=1, keep_number=True).filter("ret IS NOT NULL")
    part = F.floor((F.col("__rn") - 2) / n)
    days = (
        rets.groupBy(*keys, part.alias("part"))
        .agg(F.count("ret").alias("m"), F.round(F.stddev_samp("ret") * ANNUAL, 9).alias("rv"))
        .filter(F.col("m") == n)
    )
    now = (
        rets.filter(F.col("__n") - F.col("__rn") < n)
        .groupBy(*keys)
        .agg(F.count("ret").alias("m"), F.round(F.stddev_samp("ret") * ANNUAL, 9).alias("rv_now"))
        .filter(F.col("m") == n)
        .drop("m")
    )
    p = F.count_if(F.col("rv") <= F.col("rv_now")) / F.count("rv") * 100
    pct = F.col("percentile")
    return (
        days.join(now, keys)
        .groupBy(*keys, "rv_now")
        .agg(F.count("rv").alias("days"), F.when(F.count("rv") >= min_days, p).alias("percentile"))
        .withColumn(
            # fixed values: limits and labels
            "label",
            F.when(
                pct.isNotNull(),
                ladder(
                    (pct <= 20, "MUY BAJA"), (pct <= 40, "BAJA"), (pct <= 60, "MEDIA"), (pct <= 80, "ALTA"),
                    otherwise="MUY ALTA",
                ),
            ),
        )
    )


def parkinson(w: WindowSpec, n: int) -> Column:
    return full(w, n, F.sqrt(F.sum("__hl2").over(last_n(w, n)) / (4 * n * math.log(2))))


def parkinson_vol(bars: DataFrame, keys: Sequence[str], n: int = 24) -> DataFrame:
    def add(rows, w):
        return rows.withColumn("parkinson", parkinson(w, n)).drop("__hl2")

    squared = F.pow(log_ratio("high", "low"), F.lit(2))
    return row_frames(bars.withColumn("__hl2", squared), keys, ["ts"], add, back=n)


def causal_z(w: WindowSpec, name: str, n: int) -> Column:
    """Deviation from the n values before this row, in their sample deviations."""
    past = prior_n(w, n)
    z = div(F.col(name) - F.avg(name).over(past), F.stddev_samp(name).over(past))
    return F.when(F.count(name).over(past) == n, z)


def causal_zscore(rows: DataFrame, keys: Sequence[str], name: str, n: int, out: str = "z") -> DataFrame:
    return row_frames(rows, keys, ["ts"], lambda r, w: r.withColumn(out, causal_z(w, name, n)), back=n)


def sample_skew(w: WindowSpec, name: str, n: int) -> Column:
    """Bias-corrected skewness of the last n values."""
    frame = last_n(w, n)
    factor = math.sqrt(n * (n - 1)) / (n - 2)
    return F.when(F.count(name).over(frame) == n, F.skewness(name).over(frame) * factor)


def rolling_skew(bars: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    def add(rows, w):
        return add_ret(rows, w).withColumn("skew", sample_skew(w, "ret", n))

    return row_frames(bars, keys, ["ts"], add, back=n + 1)


def full_sum(w: WindowSpec, name: str, n: int) -> Column:
    frame = last_n(w, n)
    return F.when(F.count(name).over(frame) == n, F.sum(name).over(frame))


def relative_return(bars: DataFrame, bench: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Sum of own log returns minus the benchmark's over n bars; ``bench`` has ``ts, btc``."""

    def add(rows, w):
        rows = add_ret(rows, w).withColumn("bret", log_ratio("btc", F.lag("btc").over(w)))
        return rows.withColumn("rel", full_sum(w, "ret", n) - full_sum(w, "bret", n))

    return row_frames(asof_join(numbered(bars, keys, ["ts"]), bench, [], ["btc"]), keys, ["ts"], add, back=n + 1)


FEATURES = [
    "log_return", "realized_vol", "parkinson_vol", "taker_imbalance", "return_skew", "funding_z", "rel_return", "vix_z",
]


def regime_features(
    bars: DataFrame, funding: DataFrame, bench: DataFrame, keys: Sequence[str],
    n_vol: int = 24, n_skew: int = 20, n_z: int = 252,
) -> DataFrame:
    """The eight regime features per bar; rows with any null are dropped. ``funding``: ts, rate; ``bench``: ts, btc, vix."""
    x = asof_join(numbered(bars, keys, ["ts"]), [(funding, ["rate"]), (bench, ["btc", "vix"])], [])
    x = x.withColumn("__hl2", F.pow(log_ratio("high", "low"), F.lit(2)))
    buy, vol = F.col("taker_buy_base"), F.col("volume")

    def add(rows, w):
        rows = add_ret(rows, w).withColumn("bret", log_ratio("btc", F.lag("btc").over(w)))
        return rows.withColumns(
            {
                "log_return": F.col("ret"),
                "realized_vol": rv(w, n_vol, 1.0),
                "parkinson_vol": parkinson(w, n_vol),
                "taker_imbalance": div(2 * buy - vol, vol),
                "return_skew": sample_skew(w, "ret", n_skew),
                "funding_z": causal_z(w, "rate", n_z),
                "rel_return": full_sum(w, "ret", n_skew) - full_sum(w, "bret", n_skew),
                "vix_z": causal_z(w, "vix", n_z),
            }
        )

    rows = row_frames(x, keys, ["ts"], add, back=max(n_vol, n_skew, n_z) + 1)
    return rows.select(*keys, "ts", *FEATURES).dropna()


def standardize(rows: DataFrame, train: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Z-scores by the training rows' mean and sample deviation; a zero deviation counts as 1."""
    stats = train.groupBy(*keys).agg(
        *[F.avg(n).alias(f"{n}__m") for n in names], *[F.stddev_samp(n).alias(f"{n}__s") for n in names]
    )
    joined = rows.join(stats, list(keys))
    z = {n: (F.col(n) - F.col(f"{n}__m")) / F.when(F.col(f"{n}__s") == 0, 1.0).otherwise(F.col(f"{n}__s")) for n in names}
    return joined.withColumns(z).select(*rows.columns)


# -- flow and level indicators -----------------------------------------------------------------------------------


def add_vwap(rows: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = rows.withColumn("__pv", tp * F.col("volume"))
    vwap = div(F.sum("__pv").over(last_n(w, n)), F.sum("volume").over(last_n(w, n)))
    return rows.withColumns(
        {"vwap": full(w, n, vwap), "vwap_std": full(w, n, F.stddev_samp("close").over(last_n(w, n)))}
    ).drop("__pv")


def band_position() -> Column:
    c, v, s = F.col("close"), F.col("vwap"), F.col("vwap_std")
    return F.when(v.isNull() | s.isNull() | (s == 0), "unknown").otherwise(
        ladder((c > v + s, "above_va"), (c < v - s, "below_va"), otherwise="in_va")
    )


def vwap_band(bars: DataFrame, keys: Sequence[str], n: int = 24) -> DataFrame:
    out = row_frames(bars, keys, ["ts"], lambda r, w: add_vwap(r, w, n), back=n)
    return out.withColumn("position", band_position())


def pct_change(bars: DataFrame, bench: DataFrame, keys: Sequence[str], n: int = 24) -> DataFrame:
    """n-bar percent change of close relative to the benchmark."""
    x = asof_join(numbered(bars, keys, ["ts"]), bench, [], ["btc"]).withColumn("rel", div("close", "btc"))

    def add(rows, w):
        past = F.lag("rel", n).over(w)
        return rows.withColumn("chg_pct", (div(F.col("rel"), past) - 1) * 100)

    return row_frames(x, keys, ["ts"], add, back=n)


def vol_ratio(bars: DataFrame, keys: Sequence[str], short: int = 2, long: int = 24) -> DataFrame:
    def add(rows, w):
        rows = add_ret(rows, w)
        a, b = rv(w, short, 1.0), rv(w, long, 1.0)
        return rows.withColumn("vol_ratio", F.when(b > 0, a / b))

    return row_frames(bars, keys, ["ts"], add, back=long + 1)


def add_flow(rows: DataFrame, w: WindowSpec, n: int, prefix: str) -> DataFrame:
    """Aggressive flow over the last n bars; a short history uses what exists."""
    f = last_n(w, n)
    buy = F.sum("taker_buy_base").over(f)
    sell = F.sum(F.greatest(F.col("volume") - F.col("taker_buy_base"), F.lit(0.0))).over(f)
    first_open = F.first("open").over(f)
    return rows.withColumns(
        {
            f"{prefix}buy": buy,
            f"{prefix}sell": sell,
            f"{prefix}delta": buy - sell,
            f"{prefix}ratio": F.when(sell > 0, buy / sell),
            f"{prefix}chg_pct": div(F.col("close") - first_open, first_open) * 100,
            f"{prefix}delta_vs_vol": div((buy - sell) * 100, F.sum("volume").over(f)),
        }
    )


FLOW_COLS = ["buy", "sell", "delta", "ratio", "chg_pct", "delta_vs_vol"]


def taker_flow(bars: DataFrame, keys: Sequence[str], windows: Sequence[int] = (1, 4, 12, 24)) -> DataFrame:
    """One row per bar and window length ``n``."""

    def add(rows, w):
        for n in windows:
            rows = add_flow(rows, w, n, f"f{n}_")
        return rows

    wide = row_frames(bars, keys, ["ts"], add, back=max(windows))
    parts = F.array(
        *[F.struct(F.lit(n).alias("n"), *[F.col(f"f{n}_{c}").alias(c) for c in FLOW_COLS]) for n in windows]
    )
    return wide.select(*keys, "ts", F.inline(parts))


def rotation_signal(bars: DataFrame, keys: Sequence[str], day: int = 24, week: int = 168) -> DataFrame:
    """Taker share against its day and week means; sustained deviation from one half gives the signal."""

    def add(rows, w):
        first = F.first("close").over(last_n(w, week))
        return rows.withColumns(
            {
                "avg_day": F.avg("share").over(last_n(w, day)),
                "avg_week": F.avg("share").over(last_n(w, week)),
                "vol_day": F.sum("volume").over(last_n(w, day)),
                "chg_week_pct": F.when(first > 0, (F.col("close") - first) / first * 100).otherwise(0.0),
            }
        )

    rows = bars.filter("volume > 0").withColumn("share", F.col("taker_buy_base") / F.col("volume"))
    a = F.col("avg_day")
    return row_frames(rows, keys, ["ts"], add, back=week).withColumn(
        "signal", ladder((a > 0.54, "BTC_TO_ETH"), (a < 0.46, "ETH_TO_BTC"), otherwise="BALANCED")
    )


def last_rows(bars: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The last n rows of every key."""
    rows = numbered(bars, keys, ["ts"])
    return rows.filter(F.col("__n") - F.col("__rn") < n).drop("__rn", "__n")


def forward_return(bars: DataFrame, keys: Sequence[str], horizons: Sequence[int], keep_number: bool = False) -> DataFrame:
    """``fwd_h`` = simple return to the h-th bar ahead, null near the end. A short trade's return is its negative."""

    def add(rows, w):
        return rows.withColumns({f"fwd_{h}": div(F.lead("close", h).over(w), "close") - 1 for h in horizons})

    return row_frames(bars, keys, ["ts"], add, ahead=max(horizons), keep_number=keep_number)


FAN = 64  # blocks, or groups of them, whose transfer tables one composition takes together


def dedup_triggers(triggers: DataFrame, keys: Sequence[str], gap: int, block: int = 4096) -> DataFrame:
    """Greedy thinning per key and side: keep a trigger when it lies ``gap`` bars past the last kept one.

    The rule is sequential, but a block of bars sees the past only through one number: how many of its first bars are
    still blocked (0 .. gap-1). Its transfer table says, for every such number, which trigger is the last kept. Tables of
    FAN neighbours are composed into one, those again, and so on up to one per key; then the state before each group is
    handed down the same way, and every block replays its triggers from the right start. A block holds at most one
    trigger per bar, a composition FAN tables, and the rounds grow with the logarithm of the number of blocks.
    """
    by = [*keys, "side"]
    size = max(block, gap)
    triggers = settle(triggers)  # read for the blocks, for their range and for the result
    span = triggers.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    base, hi = (span.lo or 0) // size, (span.hi or 0) // size - (span.lo or 0) // size
    blk = F.floor(F.col("pos") / size) - base  # counted from the first, so that groups of groups end in one
    blocks = settle(triggers.groupBy(*by, blk.alias("g")).agg(F.sort_array(F.collect_list("pos")).alias("ps")))
    start = (F.col("g") + base) * size
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(gap - 1)),
        lambda a: F.aggregate("ps", start + a - F.lit(gap).cast("bigint"),
                              lambda last, p: F.when(p - last >= gap, p).otherwise(last)))
    tables = [settle(blocks.select(*by, "g", start.alias("start"), ends.alias("ends")))]
    over = lambda last, b: F.greatest(last + gap - b["start"], F.lit(0)).cast("int")  # noqa: E731  bars of b still blocked
    while hi:
        parts = tables[-1].groupBy(*by, F.floor(F.col("g") / FAN).alias("g")).agg(
            F.sort_array(F.collect_list(F.struct("g", "start", "ends"))).alias("bs"))
        through = F.aggregate(F.slice("bs", 2, FAN), F.col("bs")[0]["ends"],
                              lambda acc, b: F.transform(acc, lambda last: F.get(b["ends"], over(last, b))))
        tables.append(settle(parts.select(*by, "g", F.col("bs")[0]["start"].alias("start"), through.alias("ends"))))
        hi //= FAN
    before = tables.pop().select(*by, "g", F.lit(-(2**60)).cast("bigint").alias("last"))
    for below in reversed(tables):
        parts = below.groupBy(*by, F.floor(F.col("g") / FAN).alias("g")).agg(
            F.sort_array(F.collect_list(F.struct("g", "start", "ends"))).alias("bs"))
        zero = F.struct(F.col("last"), F.array().cast("array<struct<g:bigint,last:bigint>>").alias("out"))
        walk = F.aggregate("bs", zero, lambda acc, b: F.struct(
            F.get(b["ends"], over(acc["last"], b)).alias("last"),
            F.concat(acc["out"], F.array(F.struct(b["g"].alias("g"), acc["last"].alias("last")))).alias("out")))
        before = settle(parts.join(before, [*by, "g"]).select(*by, F.inline(walk["out"])))
    first = F.struct(F.greatest(F.col("last"), start - gap).alias("last"), F.array().cast("array<bigint>").alias("kept"))
    replay = F.aggregate(
        "ps",
        first,
        lambda acc, p: F.when(
            p - acc["last"] >= gap, F.struct(p.alias("last"), F.concat(acc["kept"], F.array(p)).alias("kept"))
        ).otherwise(acc),
    )
    kept = blocks.join(before, [*by, "g"]).select(*by, F.explode(replay["kept"]).alias("pos"))
    return triggers.join(kept, [*by, "pos"], "left_semi")


# -- zone anchors and money quality --------------------------------------------------------------------------------


def zone_anchor(bars: DataFrame, keys: Sequence[str], fast: Stoch, carry: Sequence[str] = ("close",)) -> DataFrame:
    """Bars whose fast %K is in an extreme zone, with the bar just before the move into it.

    The anchor is the last bar outside the zone; bars too early to have a %K count as outside, so it always exists.
    """

    def add(rows, w):
        return add_stoch(rows, w, fast, "fast_k", "fast_d")

    rows = settle(row_frames(bars, keys, ["ts"], add, back=stoch_reach([fast]), keep_number=True))
    k = F.col("fast_k")
    rows = rows.withColumn("direction", ladder((k >= 80, "short"), (k <= 20, "long")))
    here = F.struct(F.col("__rn").alias("rn"), F.col("ts").alias("ts"), *[F.col(c).alias(c) for c in carry])
    outside = lambda side: F.when(F.coalesce(F.col("direction") != side, F.lit(True)), here)
    rows = running_last(rows, keys, ["ts"], {"__short": outside("short"), "__long": outside("long")})
    a = F.when(F.col("direction") == "short", F.col("__short")).otherwise(F.col("__long"))
    return (
        rows.filter("direction IS NOT NULL")
        .withColumn("__a", a)
        .withColumns({"anchor_ts": F.col("__a.ts"), "anchor_bars": F.col("__rn") - F.col("__a.rn")})
        .withColumns({f"anchor_{c}": F.col(f"__a.{c}") for c in carry})
        .drop("__a", "__short", "__long", "__rn", "__n")
    )


def ratio_of(price_pct: Column, oi_pct: Column) -> Column:
    """|price change| per |OI change|; null when OI hardly moved."""
    return F.when(F.abs(oi_pct) > 0.01, F.abs(price_pct) / F.abs(oi_pct))


# Names of the readings, by direction, from most to least new money behind the move.
CUT_LABELS = {
    "short": [
        ("Acumulación real (longs nuevos)", "block"), ("Balanceado (longs mixto)", "neutral"),
        ("Covering dominante", "upgrade-mid"), ("Squeeze puro", "upgrade-high"),
        ("Short covering (OI plano)", "upgrade-mid"), ("Distribución arriba (OI cae)", "upgrade-high"),
    ],
    "long": [
        ("Distribución real (shorts nuevos)", "block"), ("Balanceado (shorts mixto)", "neutral"),
        ("Liquidation dominante", "upgrade-mid"), ("Long squeeze puro", "upgrade-high"),
        ("Long cerrando (OI plano)", "upgrade-mid"), ("Long capitulation", "upgrade-high"),
    ],
}


def cut_anchored_mq(bars: DataFrame, keys: Sequence[str], fast: Stoch) -> DataFrame:
    """How OI and price moved since the anchor, read as new money or as covering. Needs ``oi`` and finer ``oi_fine``."""
    rows = zone_anchor(bars, keys, fast, ["close", "oi", "oi_fine"])
    fine = F.col("oi_fine").isNotNull() & F.col("anchor_oi_fine").isNotNull()
    now, then = F.when(fine, F.col("oi_fine")).otherwise(F.col("oi")), F.when(
        fine, F.col("anchor_oi_fine")
    ).otherwise(F.col("anchor_oi"))
    rows = rows.withColumns(
        {
            "price_pct": div(F.col("close") - F.col("anchor_close"), "anchor_close") * 100,
            "oi_source": F.when(fine, "fine").otherwise("coarse"),
            "oi_pct": F.when(then > 0, (now - then) / then * 100),
        }
    ).withColumn("ratio", ratio_of(F.col("price_pct"), F.col("oi_pct")))
    oi, r = F.col("oi_pct"), F.col("ratio")
    step = ladder(
        ((oi > 0.10) & (r < 1), 0), ((oi > 0.10) & (r < 2), 1), ((oi > 0.10) & (r < 5), 2), (oi > 0.10, 3),
        (oi >= -0.10, 4), (oi < -0.10, 5),
    )
    rows = rows.withColumn("__step", step)

    def pick(i):
        out = None
        for d, names in CUT_LABELS.items():
            for s, pair in enumerate(names):
                cond = (F.col("direction") == d) & (F.col("__step") == s)
                out = F.when(cond, pair[i]) if out is None else out.when(cond, pair[i])
        return out

    label = F.when(oi.isNull(), "OI no disponible para el corte").otherwise(pick(0))
    return rows.withColumns({"label": label, "quality": pick(1)}).drop("__step")


# Window name -> (hours, weight in the verdict).
MQ_WINDOWS = {
    "1h": (1, 1.0), "4h": (4, 2.0), "12h": (12, 2.0), "24h": (24, 1.5), "3d": (72, 1.2), "7d": (168, 1.0), "14d": (336, 0.8),
}
MQ_LONG = ("3d", "7d", "14d")
# Quality -> factor in the verdict.
MQ_QUALITY = {"high": 1.0, "medium": 0.6, "low": 0.3}


def mq_class() -> tuple[Column, Column, Column]:
    """(label, direction, quality) from ``price_pct``, ``oi_pct`` and ``ratio``."""
    p, o, r = F.col("price_pct"), F.col("oi_pct"), F.col("ratio")
    up, dn, oi_up, oi_dn = p > 0.05, p < -0.05, o > 0.10, o < -0.10
    # Fixed values: (condition, label, direction, quality), first match wins.
    rows = [
        (up & oi_up & (r < 1), "Acumulación real", "bullish", "high"),
        (up & oi_up & (r < 2), "Balanceado (longs mixto)", "bullish", "medium"),
        (up & oi_up & (r < 5), "Covering dominante", "bullish", "low"),
        (up & oi_up, "Squeeze puro", "bullish", "low"),
        (up & ~oi_dn, "Short covering (OI plano)", "bullish", "low"),
        (up, "Distribución arriba (OI cae)", "neutral", "low"),
        (dn & oi_up & (r < 1), "Distribución real", "bearish", "high"),
        (dn & oi_up & (r < 2), "Balanceado (shorts mixto)", "bearish", "medium"),
        (dn & oi_up & (r < 5), "Liquidation dominante", "bearish", "low"),
        (dn & oi_up, "Long squeeze puro", "bearish", "low"),
        (dn & ~oi_dn, "Long cerrando (OI plano)", "bearish", "low"),
        (dn, "Long capitulation", "bearish", "high"),
        (oi_up, "Build-up (lateral)", "neutral", "medium"),
        (oi_dn, "Deleverage (lateral)", "neutral", "medium"),
    ]
    rest = ("Sin actividad", "neutral", "low")
    return tuple(ladder(*[(row[0], row[i + 1]) for row in rows], otherwise=F.lit(rest[i])) for i in range(3))


def add_mq(rows: DataFrame, w: WindowSpec, windows=MQ_WINDOWS) -> DataFrame:
    """One array column ``mq`` with a struct per window that has enough history."""
    parts = []
    for name, (h, weight) in windows.items():
        past_oi, past_close = F.lag("oi", h).over(w), F.lag("close", h).over(w)
        if name in MQ_LONG:
            price = F.when(past_close > 0, (F.col("close") - past_close) / past_close * 100)
        else:
            opened = F.first("open").over(last_n(w, h))
            price = div(F.col("close") - opened, opened) * 100
        part = F.struct(
            F.lit(name).alias("win"), F.lit(weight).alias("weight"), F.round(price, 3).alias("price_pct"),
            F.when(past_oi > 0, (F.col("oi") - past_oi) / past_oi * 100).alias("oi_pct"),
        )
        parts.append(F.when((F.col("__rn") > h) & (past_oi > 0) & price.isNotNull(), part))
    return rows.withColumn("mq", F.array_compact(F.array(*parts)))


def money_quality(bars: DataFrame, keys: Sequence[str], windows=MQ_WINDOWS) -> DataFrame:
    """Per bar and window: price change against OI change, and what it says about new money."""
    reach = max(h for h, _ in windows.values())
    rows = row_frames(bars, keys, ["ts"], lambda r, w: add_mq(r, w, windows), back=reach)
    out = rows.select(*keys, "ts", F.inline("mq")).withColumn(
        "ratio", ratio_of(F.col("price_pct"), F.col("oi_pct"))
    )
    label, direction, quality = mq_class()
    return out.withColumns({"label": label, "direction": direction, "quality": quality})


def money_quality_verdict(mq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted direction times quality over the windows of a bar, and its verdict.

    The score is cut to nine digits first, so that the order of a sum cannot tip it over a limit.
    """
    s = ladder((F.col("direction") == "bullish", 1), (F.col("direction") == "bearish", -1), otherwise=F.lit(0))
    q = ladder(*[(F.col("quality") == k, v) for k, v in MQ_QUALITY.items()])
    score = F.col("score")
    return (
        mq.groupBy(*keys, "ts")
        .agg(F.round(F.sum(s * F.col("weight") * q) / F.sum("weight"), 9).alias("score"))
        .withColumn(
            "verdict",
            ladder(
                # fixed values: limits and labels
                (score > 0.4, "ALCISTA con plata nueva"), (score > 0.15, "Alcista débil / covering"),
                (score < -0.4, "BAJISTA con plata nueva"), (score < -0.15, "Bajista débil / covering"),
                otherwise="Lateral / rotación",
            ),
        )
    )


def funding_context(rate) -> Column:
    r = F.col(rate)
    return ladder(
        # fixed values: limits and labels
        (r < -0.00005, "Funding negativo — shorts cargados"), (r > 0.00008, "Funding positivo — longs cargados"),
        (r.isNotNull(), "Funding neutro"),
    )
