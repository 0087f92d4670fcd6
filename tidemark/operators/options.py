"""Option chains: one row per listed instrument (``expiry strike is_call oi iv`` with iv in percent), per key.

Two expiry clocks are in use: midnight with whole days and a 365-day year for exposure and term structure, and 08:00
with fractional days and a 365.25-day year for skew and the expiry calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bs_delta, bs_gamma, bucket, div, ladder
from ..plans.ordered import top_k


def days_left(as_of: Column, hour: int = 0) -> Column:
    """Days to expiry: whole days from midnight, or fractional days to the given hour."""
    if hour == 0:
        return F.floor((F.unix_seconds("expiry") - F.unix_seconds(as_of)) / 86400)
    return (F.unix_seconds("expiry") + hour * 3600 - F.unix_seconds(as_of)) / 86400


def moneyness(options: DataFrame, spot: float, pct: float) -> DataFrame:
    """Strikes within a share of the spot; the bounds are constants and reach the scan of a strike column."""
    return options.filter(F.col("strike").between(spot * (1 - pct), spot * (1 + pct)))


def iv_term_structure(options: DataFrame, keys: Sequence[str], as_of: Column, spot: float) -> DataFrame:
    """Mean IV per day to expiry, weighted by open interest and nearness to the money."""
    m = F.abs(F.col("strike") - spot) / spot
    w = F.greatest(1 - m * 5, F.lit(0.1)) * F.col("oi")
    return (
        options.withColumns({"dte": days_left(as_of), "m": m, "w": w})
        .filter("dte BETWEEN 0 AND 180 AND iv > 0 AND oi > 0 AND m <= 0.20")
        .groupBy(*keys, "dte")
        .agg((F.sum(F.col("iv") * F.col("w")) / F.sum("w")).alias("iv"))
    )


def exposures(options: DataFrame, as_of: Column, spot: float, max_dte: int = 60) -> DataFrame:
    """Signed gamma exposure per instrument: calls add, puts subtract."""
    rows = options.withColumn("dte", days_left(as_of)).filter(
        (F.col("dte") >= 0) & (F.col("dte") <= max_dte) & (F.col("oi") > 0)
    )
    gamma = bs_gamma(F.lit(spot), F.col("strike"), F.col("dte") / 365.0, F.col("iv") / 100.0)
    gex = F.col("oi") * gamma * spot * spot
    return rows.withColumns({"gamma": gamma, "gex": F.when(F.col("is_call"), gex).otherwise(-gex)})


def _oi(call: bool) -> Column:
    return F.sum(F.when(F.col("is_call") == call, F.col("oi")).otherwise(0.0))


def gex_by_strike(exposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return exposed.groupBy(*keys, "strike").agg(
        F.sum("gex").alias("gex"), _oi(True).alias("call_oi"), _oi(False).alias("put_oi")
    )


def gex_bars(exposed: DataFrame, keys: Sequence[str], spot: float, size: float = 50.0) -> DataFrame:
    """Exposure in price buckets near the spot, over all expiries (``expiry`` null) and per expiry, in one pass."""
    rows = moneyness(exposed, spot, 0.15).withColumn("bucket", bucket("strike", size))
    k = [F.col(c) for c in keys]
    b, e = F.col("bucket"), F.col("expiry")
    return rows.groupingSets([[*k, b], [*k, b, e]], *k, b, e).agg(
        F.sum("gex").alias("gex"), _oi(True).alias("call_oi"), _oi(False).alias("put_oi"),
        F.grouping("expiry").alias("overall"),
    )


def gamma_flip(by_strike: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lowest strike pair where exposure turns from negative to non-negative, interpolated.

    All negative: the top strike. All non-negative: the bottom one. Group size: the listed strikes of a key.
    """
    w = Window.partitionBy(*keys).orderBy("strike")
    rows = by_strike.withColumns({"p": F.lag("strike").over(w), "pg": F.lag("gex").over(w)})
    hit = (F.col("pg") < 0) & (F.col("gex") >= 0)
    at = F.col("p") + (F.col("strike") - F.col("p")) * (-F.col("pg") / (F.col("gex") - F.col("pg")))
    return (
        rows.groupBy(*keys)
        .agg(
            F.min_by(F.when(hit, at), F.when(hit, F.col("strike"))).alias("cross_at"),
            F.when(F.max("gex") < 0, F.max("strike")).alias("top"),
            F.when(F.min("gex") >= 0, F.min("strike")).alias("bottom"),
            F.sum("gex").alias("total_gex"),
        )
        .select(*keys, F.coalesce("cross_at", "top", "bottom").alias("flip"), "total_gex")
    )


def option_walls(by_strike: DataFrame, keys: Sequence[str], spot: float) -> DataFrame:
    """Strike with most call interest above the spot and most put interest below it, within a fifth of the spot."""
    k = F.col("strike")
    near = by_strike.filter(k.between(spot * 0.80, spot * 1.20))
    best = lambda cond, oi: F.max_by(F.when(cond, k), F.when(cond, F.struct(oi, -k)))
    return (
        near.groupBy(*keys)
        .agg(best(k > spot, F.col("call_oi")).alias("call_wall"), best(k < spot, F.col("put_oi")).alias("put_wall"))
        .withColumns(
            {
                "call_dist": (F.col("call_wall") - spot) / spot * 100,
                "put_dist": (F.col("put_wall") - spot) / spot * 100,
            }
        )
    )


def gex_zones(exposed: DataFrame, flip: DataFrame, keys: Sequence[str], spot: float) -> DataFrame:
    """Interest and exposure above and below the flip (the spot where there is none)."""
    rows = moneyness(exposed, spot, 0.15).join(flip.select(*keys, "flip"), list(keys), "left")
    above = F.col("strike") >= F.coalesce("flip", F.lit(spot))
    c, p = F.col("call_oi"), F.col("put_oi")
    return (
        rows.groupBy(*keys, F.when(above, "above").otherwise("below").alias("zone"))
        .agg(_oi(True).alias("call_oi"), _oi(False).alias("put_oi"), (F.sum("gex") / 1e6).alias("net_gex_m"))
        .withColumns(
            {
                "call_pct": F.coalesce(div(c * 100, c + p), F.lit(0.0)),
                "dominant": F.when(p > c, "puts").otherwise("calls"),
            }
        )
    )


def max_pain(options: DataFrame, keys: Sequence[str], as_of: Column, max_dte: int = 60) -> DataFrame:
    """Per expiry the strike at which option holders are paid least.

    The payout at a strike comes from running sums over the strikes below and above it, so no strike meets every
    option. Ties go to the lower strike.
    """
    by = [*keys, "expiry"]
    rows = options.withColumn("dte", days_left(as_of)).filter(
        (F.col("dte") >= 0) & (F.col("dte") <= max_dte) & (F.col("oi") > 0)
    )
    levels = rows.groupBy(*by, "strike").agg(_oi(True).alias("c"), _oi(False).alias("p"))
    w = Window.partitionBy(*by).orderBy("strike")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")
    total = lambda e, f: F.coalesce(F.sum(e).over(f), F.lit(0.0))
    calls = k * total("c", below) - total(k * F.col("c"), below)
    puts = total(k * F.col("p"), above) - k * total("p", above)
    pay = levels.withColumn("pay", F.round(calls + puts, 6))
    return pay.groupBy(*by).agg(
        F.min_by("strike", F.struct("pay", "strike")).alias("max_pain"), F.min("pay").alias("pay")
    )


def option_expiries(
    options: DataFrame, keys: Sequence[str], as_of: Column, spot: float, n: int = 8, pin_pct: float = 0.02
) -> DataFrame:
    """The next expiries: interest, notional, put/call ratio and pin risk; totals per key ride along."""
    dte = days_left(as_of, 8)
    pin = F.col("strike").between(spot * (1 - pin_pct), spot * (1 + pin_pct))
    per = (
        options.withColumn("dte", dte)
        .filter("dte > 0")
        .groupBy(*keys, "expiry", "dte")
        .agg(
            _oi(True).alias("call_oi"), _oi(False).alias("put_oi"),
            F.sum(F.when(pin, F.col("oi")).otherwise(0.0)).alias("pin_oi"),
        )
        .withColumn("total_oi", F.col("call_oi") + F.col("put_oi"))
        .filter("total_oi > 0")
        .withColumns(
            {
                "notional": F.col("total_oi") * spot,
                "put_call": div("put_oi", "call_oi"),
                "pin_risk": F.col("pin_oi") / F.sqrt(F.greatest("dte", F.lit(0.25))),
            }
        )
    )
    near = top_k(per, keys, [F.col("dte")], n)
    w = Window.partitionBy(*keys)
    return near.withColumns(
        {
            "agg_put_call": div(F.sum("put_oi").over(w), F.sum("call_oi").over(w)),
            "largest": F.row_number().over(w.orderBy(F.desc("notional"), "dte")) == 1,
        }
    )


def option_skew(
    options: DataFrame, keys: Sequence[str], as_of: Column, spot: float, r: float = 0.04, strike_pct: float = 0.30
) -> DataFrame:
    """Per expiry: IV at delta +-0.25, at-the-money IV, risk reversal and butterfly.

    The IV at a delta is read between the first pair of neighbouring strikes around it, else from the strike with the
    nearest delta if that is within 0.12. Group size: the strikes of one expiry.
    """
    by = [*keys, "expiry"]
    dte = days_left(as_of, 8)
    rows = (
        moneyness(options, spot, strike_pct)
        .withColumns({"dte": dte, "v": F.col("iv") / 100.0})
        .filter("v > 0 AND dte > 0")
        .withColumn("t", F.col("dte") / 365.25)
    )
    delta = bs_delta(F.lit(spot), F.col("strike"), F.col("t"), F.lit(r), F.col("v"), F.col("is_call"))
    w = Window.partitionBy(*by, "is_call").orderBy("strike")
    rows = rows.withColumn("d0", delta).withColumns({"d1": F.lead("d0").over(w), "v1": F.lead("v").over(w)})
    target = F.when(F.col("is_call"), 0.25).otherwise(-0.25)
    d0, d1 = F.col("d0"), F.col("d1")
    hit = ((d0 >= target) & (target >= d1)) | ((d0 <= target) & (target <= d1))
    v = F.when(d1 == d0, F.col("v")).otherwise(
        F.col("v") + (target - d0) / (d1 - d0) * (F.col("v1") - F.col("v"))
    )
    off = F.round(F.abs(d0 - target), 12)

    def at(call):
        side = F.col("is_call") == call
        pair = F.min_by(F.when(side & hit, v), F.when(side & hit, F.col("strike")))
        near = F.min_by(F.when(side & (off <= 0.12), F.col("v")), F.when(side & (off <= 0.12), F.struct(off, F.col("strike"))))
        return F.coalesce(pair, near)

    atm_order = F.struct(F.abs(F.col("strike") - spot), (~F.col("is_call")).cast("int"), F.col("strike"))
    c, p, a = F.col("iv_call25"), F.col("iv_put25"), F.col("iv_atm")
    return (
        rows.groupBy(*by, "dte")
        .agg(
            at(True).alias("iv_call25"), at(False).alias("iv_put25"), F.min_by("v", atm_order).alias("iv_atm"),
            F.count(F.lit(1)).alias("strikes"), F.count_if("is_call").alias("calls"),
        )
        .filter("calls > 0 AND calls < strikes")
        .withColumns({"rr25": c - p, "bf25": 0.5 * (c + p) - a})
        .drop("calls")
    )


def skew_tenors(skew: DataFrame, keys: Sequence[str], tenors: Sequence[int] = (7, 30, 60, 90)) -> DataFrame:
    """The expiry nearest to each standard tenor."""
    cols = [c for c in skew.columns if c not in keys]
    rows = skew.withColumn("tenor", F.explode(F.array(*[F.lit(t) for t in tenors])))
    pick = F.min_by(F.struct(*cols), F.struct(F.abs(F.col("dte") - F.col("tenor")), F.col("dte")))
    return rows.groupBy(*keys, "tenor").agg(pick.alias("m")).select(*keys, "tenor", "m.*")


def gex_impact(flip: DataFrame, volume: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dealer hedging per 1% move against an hour of volume (``vol_24h``)."""
    hedge = F.abs(F.col("total_gex")) * 0.01
    pct = F.coalesce(div(hedge * 100, F.col("vol_24h") / 24), F.lit(0.0))
    p = F.col("hedge_pct")
    return (
        flip.join(volume, list(keys))
        .withColumn("hedge_pct", pct)
        .withColumn("impact", ladder((p >= 10, "ALTO"), (p >= 3, "MODERADO"), otherwise="BAJO"))
    )


def iv_rv_spread(term: DataFrame, rv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest 3-21 day IV against realized volatility (``rv``)."""
    iv = term.filter("dte BETWEEN 3 AND 21").groupBy(*keys).agg(
        F.min_by("iv", "dte").alias("iv"), F.min("dte").alias("dte")
    )
    return iv.join(rv, list(keys)).withColumns(
        {"spread": F.col("iv") - F.col("rv"), "ratio": F.when(F.col("rv") > 0, F.col("iv") / F.col("rv"))}
    )


def symbol_parts(symbols: DataFrame, name: str = "instrument") -> DataFrame:
    """'ETH-29DEC24-3000-C' to underlying, expiry (08:00), strike and side; dated futures have no strike.

    Each symbol is matched once, by a generator: Spark moves a filter on what a generator makes no further down, so symbols
    that were made distinct or grouped before are not parsed again for every row they came from.
    """
    pat = r"^([A-Z]+)-(\d{1,2}[A-Z]{3}\d{2})(?:-(\d+(?:\.\d+)?)-([CP]))?$"
    whole = F.regexp_extract(F.col(name), pat, 0)  # empty without a match; its parts hold no hyphen
    rows = symbols.select("*", F.inline(F.array(F.struct(F.split(whole, "-").alias("__p")))))
    part = lambda i: F.nullif(F.get("__p", F.lit(i)), F.lit(""))
    day = F.try_to_timestamp(F.initcap(F.lower(part(1))), F.lit("dMMMyy"))
    day = F.when(F.year(day) > 2068, F.add_months(day, -1200).cast("timestamp")).otherwise(day)  # 69 to 99 are 19xx
    expiry = F.when(part(1).isNotNull(), day + F.expr("INTERVAL 8 HOURS"))
    return rows.withColumns(
        {"und": part(0), "expiry": expiry, "strike": part(2).try_cast("double"), "is_call": part(3) == "C"}
    ).filter("expiry IS NOT NULL").drop("__p")
