"""Composite scores. Weights are a small table laid beside each bar, so all periods are scored in one pass.

The order of the steps is part of the definition: amplifiers read the score reached so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, correlation, div, half_up, ladder, sign

PERIODS = ["5m", "15m", "1h", "4h", "12h", "1d", "15d"]
# Weight of each factor, a row per period.
WEIGHTS = {
    "5m": {
        "funding": 0, "oi": 0, "oi_price": 0, "taker": 2, "ls": 1, "vol": 0, "iv_rv": 0,
        "ethbtc": 0, "gamma": 0, "vp": 1, "stoch": 1, "mq": 1, "setup": 3,
    },
    "15m": {
        "funding": 0, "oi": 0, "oi_price": 0, "taker": 2, "ls": 1, "vol": 0, "iv_rv": 0,
        "ethbtc": 0, "gamma": 0, "vp": 1, "stoch": 1, "mq": 1, "setup": 3,
    },
    "1h": {
        "funding": 1, "oi": 1, "oi_price": 1, "taker": 1, "ls": 1, "vol": 0, "iv_rv": 0,
        "ethbtc": 0, "gamma": 1, "vp": 1, "stoch": 1, "mq": 2, "setup": 3,
    },
    "4h": {
        "funding": 1, "oi": 1, "oi_price": 1, "taker": 1, "ls": 1, "vol": 1, "iv_rv": 0,
        "ethbtc": 1, "gamma": 1, "vp": 1, "stoch": 2, "mq": 2, "setup": 4,
    },
    "12h": {
        "funding": 2, "oi": 1, "oi_price": 1, "taker": 1, "ls": 1, "vol": 1, "iv_rv": 1,
        "ethbtc": 1, "gamma": 1, "vp": 1, "stoch": 2, "mq": 2, "setup": 3,
    },
    "1d": {
        "funding": 2, "oi": 2, "oi_price": 1, "taker": 1, "ls": 1, "vol": 1, "iv_rv": 1,
        "ethbtc": 1, "gamma": 2, "vp": 1, "stoch": 2, "mq": 1, "setup": 2,
    },
    "15d": {
        "funding": 2, "oi": 2, "oi_price": 1, "taker": 0, "ls": 1, "vol": 1, "iv_rv": 2,
        "ethbtc": 2, "gamma": 2, "vp": 1, "stoch": 2, "mq": 0, "setup": 0,
    },
}
# Which flow and money-quality window a period reads.
FLOW_WINDOW = ["1h", "1h", "1h", "4h", "12h", "24h", "24h"]
MQ_WINDOW = ["1h", "4h", "12h", "24h", "3d", "7d", "14d"]
# The volume profile's look-back a period reads, and the one that stands in where it is missing.
PROFILE = ["4h", "12h", "24h", "7d", "7d", "30d", "45d"]
PROFILE_ELSE = "8d"
# How near (percent) a wall and the strike of most pain must be to be noted.
NEAR_WALL, NEAR_PAIN = 3, 4
FLOW_HOURS = {"1h": 1, "4h": 4, "12h": 12, "24h": 24}
# Typical sizes of taker and long/short readings, and the limits of the intensity factor.
TYPICAL_TAKER, TYPICAL_LS, MOD_LO, MOD_HI = 0.05, 0.30, 0.5, 1.5
# Limits for the taker ratio, strong and mild, live and in the reconstruction.
TAKER_LIVE = (1.15, 1.05, 0.85, 0.95)
TAKER_HISTORY = (1.15, 1.05, 1 / 1.15, 1 / 1.05)


def by_period(rows: DataFrame) -> DataFrame:
    """Each row once per period, with that period's weights as ``w_<factor>``."""
    parts = [
        F.struct(
            F.lit(p).alias("period"), F.lit(FLOW_WINDOW[i]).alias("flow_win"), F.lit(MQ_WINDOW[i]).alias("mq_win"),
            F.lit(PROFILE[i]).alias("vp_period"),
            *[F.lit(w).alias(f"w_{k}") for k, w in WEIGHTS[p].items()],
        )
        for i, p in enumerate(PERIODS)
    ]
    return rows.select("*", F.inline(F.array(*parts)))


def half(w: str) -> Column:
    return F.ceil(F.col(w) / 2).cast("int")


def step(*cases) -> Column:
    return ladder(*cases, otherwise=F.lit(0)).cast("int")


def funding_points() -> Column:
    r, w = F.col("rate"), F.col("w_funding")
    return step((r > 0.0003, -w), (r > 0.0001, -half("w_funding")), (r < -0.0003, w), (r < -0.0001, half("w_funding")))


def taker_base(limits) -> Column:
    up, up_mild, dn, dn_mild = limits
    t, w = F.col("taker"), F.col("w_taker")
    return step((~(t > 0), 0), (t > up, w), (t > up_mild, half("w_taker")), (t < dn, -w), (t < dn_mild, -half("w_taker")))


def intensity(size: Column, typical: float) -> Column:
    return clamp(size / typical, MOD_LO, MOD_HI)


def amplify(score: str, weight: str, cond: Column) -> Column:
    return step((cond & (F.abs(score) >= 1), sign(score) * F.col(weight)))


def ethbtc_points() -> Column:
    e, w = F.col("ethbtc_chg"), F.col("w_ethbtc")
    return step((e > 2, w), (e < -2, -w))


def vp_points() -> Column:
    p, w = F.col("position"), F.col("w_vp")
    return step((p == "above_va", -w), (p == "below_va", w))


def stoch_points(cross_rule: str) -> Column:
    """Regime from the slow pair, timing from the fast one.

    ``level``: the fast pair's position alone; ``prevk_curd``: previous %K against the current %D;
    ``prevk_prevd``: a true crossing.
    """
    sk, sd, fk, fd = (F.col(x) for x in ("slow_k", "slow_d", "fast_k", "fast_d"))
    w, h = F.col("w_stoch"), half("w_stoch")
    slow = step(((sk >= 80) & (sd >= 80), -w), ((sk <= 20) & (sd <= 20), w))
    up, dn = (fk > fd) & (fk < 30) & (sk < 40), (fk < fd) & (fk > 70) & (sk > 60)
    if cross_rule != "level":
        before = F.col("fast_d") if cross_rule == "prevk_curd" else F.col("fast_d_1")
        up, dn = up & (F.col("fast_k_1") <= before), dn & (F.col("fast_k_1") >= before)
    return slow + step((up, h), (dn, -h))


def level_of(score: str) -> Column:
    s = F.col(score)
    return ladder((s >= 3, "bullish"), (s <= -3, "bearish"), (s == 0, "neutral"), otherwise="caution")


def score_history(inputs: DataFrame, warm_up: int = 410) -> DataFrame:
    """Six-factor reconstruction per bar and period, with and without the intensity factor on taker flow.

    ``inputs`` has ``__rn rate taker_ratio vol_ratio ethbtc_chg position`` and both stochastics.
    """
    rows = by_period(inputs.filter(F.col("__rn") > warm_up).withColumn("taker", F.col("taker_ratio")))
    base = F.col("c_taker_pre")
    squeezed = F.col("vol_ratio") < 0.7
    rows = rows.withColumns({"c_funding": funding_points(), "c_taker_pre": taker_base(TAKER_HISTORY)}).withColumn(
        "c_taker_post",
        F.when(base == 0, 0).otherwise(F.rint(base * intensity(F.abs(F.log("taker")), TYPICAL_TAKER))).cast("int"),
    )
    rest = {"c_ethbtc": ethbtc_points(), "c_vp": vp_points(), "c_stoch": stoch_points("prevk_curd")}
    rows = rows.withColumns(rest)
    for tag in ("pre", "post"):
        rows = rows.withColumn(f"s_{tag}", F.col("c_funding") + F.col(f"c_taker_{tag}"))
        rows = rows.withColumn(f"c_vol_{tag}", amplify(f"s_{tag}", "w_vol", squeezed))
        total = F.col(f"s_{tag}") + F.col(f"c_vol_{tag}") + sum(F.col(c) for c in rest)
        rows = rows.withColumn(f"score_{tag}", clamp(total, -10, 10))
    return rows.withColumns({"score": F.col("score_post"), "level": level_of("score_post")})


# -- live state ----------------------------------------------------------------------------------------------------


def signal_panels() -> dict[str, Column]:
    """Levels of the four stand-alone signals from ``rate oi_chg taker spot_ratio retail top``."""
    r, o, t, s, g, h = (F.col(x) for x in ("rate", "oi_chg", "taker", "spot_ratio", "retail", "top"))
    bull, bear = t > 1.15, t < 0.85
    s_bull, s_bear = F.coalesce(s > 1.05, F.lit(False)), F.coalesce(s < 0.95, F.lit(False))
    return {
        "funding_sig": ladder(
            (r > 0.0003, "bearish"), (r > 0.0001, "caution"), (r < -0.0003, "bullish"), (r < -0.0001, "caution"),
            otherwise="neutral",
        ),
        "oi_sig": ladder((F.abs(o) > 10, "caution"), otherwise="neutral"),
        "taker_sig": ladder(
            (bull & s_bull, "bullish"), (bear & s_bear, "bearish"), ((bull & s_bear) | (bear & s_bull), "caution"),
            (bull, "bullish"), (bear, "bearish"), otherwise="neutral",
        ),
        "divergence_sig": ladder(
            (g.isNull() | h.isNull(), "neutral"), ((g > 1.4) & (h < 1.15), "bearish"), ((g < 0.7) & (h > 0.85), "bullish"),
            (F.abs(g - h) > 0.5, "caution"), otherwise="neutral",
        ),
    }


# Quality of the move since the cut -> grade and tier.
CUT_GRADES = {"block": ("BLOCKED", -1), "neutral": ("A", 0), "upgrade-mid": ("A+", 1), "upgrade-high": ("A++", 2)}


def setup_columns(rows: DataFrame) -> DataFrame:
    """Alignment of slow and fast stochastics: state, direction, trigger and quality; order decides.

    Needs the stochastics, ``fast_k_1 fast_k_2`` and the cut's ``cut_direction cut_quality``. Values are taken at two
    digits, as they are published.
    """
    two = lambda c: F.round(c, 2)
    sk, sd, fk, fd, k1, k2 = (two(c) for c in ("slow_k", "slow_d", "fast_k", "fast_d", "fast_k_1", "fast_k_2"))
    known = sk.isNotNull() & sd.isNotNull() & fk.isNotNull() & fd.isNotNull()
    s_ob, s_os = (sk >= 80) & (sd >= 80), (sk <= 20) & (sd <= 20)
    f_ob, f_os = (fk >= 80) & (fd >= 80), (fk <= 20) & (fd <= 20)
    was_ob, was_os = (k1 >= 80) & (k2 >= 80), (k1 <= 20) & (k2 <= 20)
    # (condition, direction, state, trigger), first match wins. A pair that is in the zone cannot have left it, so of
    # an armed pair's triggers only the entry below 75 (above 25) from outside could fire, and it cannot either.
    table = [
        (s_ob & f_ob, "short", "ARMED", None),
        (s_ob & was_ob & (fk < 75), "short", "TRIGGERED", "strict"),
        (s_ob & was_ob & (fk < 80), "short", "TRIGGERED", "standard"),
        ((s_ob | (sk >= 75)) & (k1 < 80) & (fk < 70) & was_ob, "short", "LATE", None),
        (s_os & f_os, "long", "ARMED", None),
        (s_os & was_os & (fk > 25), "long", "TRIGGERED", "strict"),
        (s_os & was_os & (fk > 20), "long", "TRIGGERED", "standard"),
        ((s_os | (sk <= 25)) & (k1 > 20) & (fk > 30) & was_os, "long", "LATE", None),
    ]
    pick = lambda i, rest: F.when(known, ladder(*[(t[0], t[i]) for t in table], otherwise=F.lit(rest)))
    rows = rows.withColumns(
        {"setup_state": pick(2, "INACTIVE"), "setup_dir": pick(1, None), "setup_trigger": pick(3, None)}
    )
    graded = ladder(*[(F.col("cut_quality") == q, g) for q, (g, _) in CUT_GRADES.items()], otherwise=F.lit("A"))
    live = F.col("setup_state").isin("ARMED", "TRIGGERED")
    return rows.withColumn(
        "setup_quality",
        F.when(live, F.when(F.col("cut_direction") == F.col("setup_dir"), graded).otherwise("A")),
    )


def mq_grade(mq: DataFrame) -> DataFrame:
    """Each money-quality reading against a short and a long setup: verdict and tier."""
    r, d, s = F.col("ratio"), F.col("direction"), F.col("setup")
    same = ((s == "short") & (d == "bullish")) | ((s == "long") & (d == "bearish"))
    tier = ladder(
        (r.isNull() | ~same, 0), (r < 1, -1), (r >= 5, 2), (r >= 2, 1), otherwise=F.lit(0)
    )
    return mq.withColumn("setup", F.explode(F.array(F.lit("short"), F.lit("long")))).withColumn("tier", tier).withColumn(
        "verdict", ladder((F.col("tier") < 0, "BLOCK"), (F.col("tier") > 0, "UPGRADE"), otherwise="NEUTRAL")
    )


# Share of the setup weight by quality and by state.
SETUP_QUALITY = {"A++": 1.5, "A+": 1.25, "A": 1.0}
SETUP_STATE = {"TRIGGERED": 1.0, "ARMED": 0.6, "LATE": 0.2}
# Share of the money-quality weight by quality.
MQ_SHARE = {"high": 1.0, "medium": 0.5, "low": 0.25}


def state_score(inputs: DataFrame) -> DataFrame:
    """Twelve factors per bar and period, in order; ``score`` and ``score_pre`` are clamped to +-10.

    ``inputs``: rate oi_chg chg_24 f1_ratio f4_ratio f12_ratio f24_ratio retail top vol_ratio_live iv_spread ethbtc_chg
    flip close, both stochastics, the setup columns, ``mq`` (map window -> direction, quality), ``profile`` (map
    look-back -> position) and ``verdict``.
    """
    rows = by_period(inputs)
    rows = rows.withColumn(
        "position", F.coalesce(F.try_element_at("profile", F.col("vp_period")), F.try_element_at("profile", F.lit(PROFILE_ELSE)))
    )
    taker = ladder(*[(F.col("flow_win") == n, F.col(f"f{h}_ratio")) for n, h in FLOW_HOURS.items()])
    rows = rows.withColumns({"taker": taker, "mq_now": F.try_element_at("mq", F.col("mq_win"))})
    r, o, p24 = F.col("rate"), F.col("oi_chg"), F.col("chg_24")
    g, h = F.col("retail"), F.col("top")
    w = {k: F.col(f"w_{k}") for k in WEIGHTS[PERIODS[0]]}
    rows = rows.withColumns(
        {
            "c1": funding_points(),
            "c2": step(((o > 8) & (r > 0.0001), -w["oi"]), ((o > 8) & (r < -0.0001), w["oi"]))
            + step(((o > 5) & (p24 > 2), w["oi_price"]), ((o > 5) & (p24 < -2), -w["oi_price"])),
            "b3": taker_base(TAKER_LIVE),
            "b4": step(((g > 1.4) & (h < 1.15), -w["ls"]), ((g < 0.7) & (h > 0.85), w["ls"])),
        }
    )
    modulated = lambda b, size, typ: F.when(
        F.col(b) == 0, 0
    ).otherwise(half_up(F.col(b) * intensity(size, typ))).cast("int")
    rows = rows.withColumns(
        {
            "c3": modulated("b3", F.abs(F.log("taker")), TYPICAL_TAKER),
            "c4": modulated("b4", F.abs(g - h), TYPICAL_LS),
        }
    )
    rows = rows.withColumns(
        {
            "run4": F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4"),
            "mod_delta": F.col("c3") - F.col("b3") + F.col("c4") - F.col("b4"),
        }
    )
    rows = rows.withColumn("c5", amplify("run4", "w_vol", F.col("vol_ratio_live") < 0.7))
    rows = rows.withColumn("run5", F.col("run4") + F.col("c5"))
    rows = rows.withColumn("c6", amplify("run5", "w_iv_rv", F.col("iv_spread") > 15))
    points = F.greatest(F.lit(1), half_up(w["mq"] * ladder(*[(F.col("mq_now.quality") == q, s) for q, s in MQ_SHARE.items()])))
    d = F.col("mq_now.direction")
    rows = rows.withColumns(
        {
            "c7": ethbtc_points(),
            "c8": step((F.col("flip").isNull(), 0), (F.col("close") > F.col("flip"), w["gamma"]), (F.lit(True), -w["gamma"])),
            "c9": vp_points(),
            "c10": stoch_points("level"),
            "c11": step((w["mq"] == 0, 0), (d == "bullish", points), (d == "bearish", -points)),
        }
    )
    rows = rows.withColumn("run11", F.col("run5") + sum(F.col(f"c{i}") for i in range(6, 12)))
    quiet = (F.abs("run11") <= 1) & (w["mq"] > 0)
    pts = half_up(
        w["setup"]
        * ladder(*[(F.col("setup_quality") == q, s) for q, s in SETUP_QUALITY.items()], otherwise=F.lit(0.0))
        * ladder(*[(F.col("setup_state") == q, s) for q, s in SETUP_STATE.items()], otherwise=F.lit(0.0))
    )
    rows = rows.withColumns(
        {
            "c11v": step((quiet & F.col("verdict").startswith("ALCISTA"), 1), (quiet & F.col("verdict").startswith("BAJISTA"), -1)),
            "c12": step((F.col("setup_dir") == "short", -pts), (F.col("setup_dir") == "long", pts)),
        }
    )
    score = clamp(F.col("run11") + F.col("c11v") + F.col("c12"), -10, 10)
    return rows.withColumn("score", score).withColumn("score_pre", clamp(F.col("score") - F.col("mod_delta"), -10, 10))


CONTRIBUTIONS = ["c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9", "c10", "c11", "c11v", "c12"]


def state_level(scored: DataFrame) -> DataFrame:
    """Level, conclusion code, notes and regime warnings of a scored row.

    Needs ``vol_pct`` and the option levels ``call_wall put_wall max_pain``.
    """
    s, v, o, r, t = (F.col(c) for c in ("score", "vol_pct", "oi_chg", "rate", "taker"))
    calm, hot = F.coalesce(v <= 30, F.lit(False)), F.coalesce(v >= 75, F.lit(False))
    cleansing = F.coalesce((o < -8) & (F.abs(s) <= 1), F.lit(False))
    above, below = F.col("close") > F.col("flip"), F.col("close") <= F.col("flip")
    away = lambda level: (F.col(level) - F.col("close")) / F.col("close") * 100
    codes = lambda *cs: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in cs])), ",")
    return scored.withColumns(
        {
            "level": F.when(cleansing, "neutral").otherwise(level_of("score")),
            "conclusion": ladder(
                (cleansing, "CLEANSING"), ((s >= 3) & calm, "UP_IDEAL"), ((s >= 3) & hot, "UP_TIRED"), (s >= 3, "UP"),
                ((s <= -3) & calm, "DOWN_IDEAL"), ((s <= -3) & hot, "DOWN_TIRED"), (s <= -3, "DOWN"),
                (s == 2, "MILD_UP"), (s == -2, "MILD_DOWN"), (F.abs(s) == 1, "SLIGHT"), otherwise="NONE",
            ),
            "notes": codes(
                ((F.col("position") == "at_poc") & (F.abs(s) <= 2), "AT_POC"), (below & (s <= -3), "BELOW_FLIP_DOWN"),
                (below & (s >= 3), "BELOW_FLIP_UP"), (above & (s >= 3), "ABOVE_FLIP_UP"), (above & (s <= -3), "ABOVE_FLIP_DOWN"),
                (away("call_wall") < NEAR_WALL, "CALL_WALL"), (F.abs(away("put_wall")) < NEAR_WALL, "PUT_WALL"),
                (F.abs(away("max_pain")) < NEAR_PAIN, "MAX_PAIN"),
            ),
            "warnings": codes(
                ((r > 0.0002) & (t > 1.1), "LONGS_PAYING_TAKERS_BUYING"), ((r < -0.0002) & (t < 0.9), "SHORTS_PAYING_TAKERS_SELLING"),
                ((o < -10) & (v > 70), "LIQUIDATION_CASCADE"), ((F.col("vol_ratio_live") < 0.7) & (o > 5), "COILED"),
            ),
        }
    )


def score_correlation(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlation of every pair of factor contributions per period.

    One aggregate with a corr per pair: the pairs are of columns, not of rows.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = scored.groupBy("period").agg(*[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr")) for a, b in pairs])
    return wide.select("period", F.inline(parts))


def aligned_timeframes(setups: DataFrame, keys: Sequence[str], current: str) -> DataFrame:
    """Timeframes (``tf``) whose open setup agrees with the current timeframe's direction and is not blocked."""
    now = setups.filter((F.col("tf") == current) & F.col("setup_dir").isNotNull()).select(
        *keys, F.col("setup_dir").alias("direction")
    )
    ok = setups.filter(F.col("setup_state").isin("ARMED", "TRIGGERED") & (F.col("setup_quality") != "BLOCKED"))
    hits = ok.select(*keys, "tf", F.col("setup_dir").alias("direction"))
    return (
        now.join(hits, [*keys, "direction"], "left")
        .groupBy(*keys, "direction")
        .agg(F.array_join(F.sort_array(F.collect_list("tf")), ",").alias("aligned"), F.count("tf").alias("n"))
    )


def live_inputs(
    bars: DataFrame, slow_sides: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str], slow, fast,
    day: int = 24, oi_steps: int = 48,
) -> DataFrame:
    """Everything the live score reads at a bar, in one as-of pass and one framed pass.

    ``slow_sides`` bring rate, btc, retail and top.
    """
    from ..plans.ordered import asof_join, numbered, row_frames
    from .indicators import add_flow, add_ret, add_stoch, rv, stoch_reach

    keys = list(keys)
    firsts = bars.groupBy(*keys).agg(F.min_by(F.col("oi") * F.col("close"), "ts").alias("__first_oi"))
    x = asof_join(numbered(bars, keys, ["ts"]), slow_sides, []).join(firsts, keys)
    x = x.withColumns({"__oi": F.col("oi") * F.col("close"), "__rel": F.col("close") / F.nullif("btc", F.lit(0.0))})

    def add(rows, w):
        rows = add_stoch(add_stoch(rows, w, slow, "slow_k", "slow_d"), w, fast, "fast_k", "fast_d")
        rows = add_ret(rows, w)
        for n in FLOW_HOURS.values():
            rows = add_flow(rows, w, n, f"f{n}_")
        past = F.coalesce(F.lag("__oi", oi_steps).over(w), "__first_oi")
        rows = rows.withColumns({f"rv_{n}": rv(w, n) for n in (4, 24)})
        return rows.withColumns(
            {
                **{f"fast_{x}_{i}": F.lag(f"fast_{x}", i).over(w) for x in "kd" for i in (1, 2)},
                "oi_chg": F.when((F.col("__rn") >= 2) & (past != 0), (F.col("__oi") - past) / past * 100),
                "chg_24": (div("close", F.lag("close", day).over(w)) - 1) * 100,
                "ethbtc_chg": (F.col("__rel") / F.nullif(F.lag("__rel", day).over(w), F.lit(0.0)) - 1) * 100,
                "vol_ratio_live": F.when(F.col("rv_24") > 0, F.col("rv_4") / F.col("rv_24")),
            }
        )

    reach = max(stoch_reach([slow, fast]) + 2, 169, oi_steps, day)
    rows = row_frames(x, keys, ["ts"], add, back=reach, keep_number=True)
    return rows


def with_levels(
    inputs: DataFrame, keys: Sequence[str], spot: DataFrame, options: DataFrame, spread: DataFrame, profile: DataFrame,
) -> DataFrame:
    """Join what the live score reads from elsewhere.

    ``spot``: keys, ts, spot_ratio (takers on the spot market, same bar); ``options``: keys, flip, call_wall, put_wall,
    max_pain; ``spread``: keys, iv_spread; ``profile``: keys, period, position. The last three have a few rows per key.
    """
    keys = list(keys)
    shape = profile.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("period", "position"))).alias("profile"))
    out = inputs.join(spot, [*keys, "ts"], "left")
    for side in (options, spread, shape):
        out = out.join(side, keys, "left")
    return out


def with_quality(inputs: DataFrame, mq: DataFrame, verdict: DataFrame, cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the money-quality readings (as a map per bar), the verdict and the cut reading."""
    at = [*keys, "ts"]
    per_bar = mq.groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("win", F.struct("direction", "quality")))).alias("mq")
    )
    cuts = cut.select(*at, F.col("direction").alias("cut_direction"), F.col("quality").alias("cut_quality"))
    return inputs.join(per_bar, at, "left").join(verdict.select(*at, "verdict"), at, "left").join(cuts, at, "left")
