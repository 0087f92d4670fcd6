"""Positions, funding, basis, open interest and long/short ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket, clamp, div, ladder
from ..plans.ordered import asof_join, nearest_join, row_frames
from ..plans.settle import settle

# Cover of a short by spot from which it counts as fully or partly hedged, and the spot share of a
# long from which it counts as a doubled bet.
HEDGE_FULL, HEDGE_PARTIAL, DOUBLE_SPOT = 0.8, 0.3, 0.3


def positions_book(positions: DataFrame, spot: float) -> DataFrame:
    """Side, size, distance to liquidation and hedge label per position.

    The cover ratio is rounded to three digits before the label test; the limits are inclusive.
    """
    size = F.abs("szi")
    held = F.col("spot_eth") + F.col("mainnet_eth")
    ratio = F.round(F.least(div(held, size), F.lit(1.0)), 3)
    short = F.col("side") == "SHORT"
    return (
        positions.filter("szi IS NOT NULL AND szi <> 0")
        .withColumns(
            {
                "side": F.when(F.col("szi") > 0, "LONG").otherwise("SHORT"),
                "size_eth": size,
                "size_usd": size * spot if spot else size * F.col("entry_px"),
                "dist_liq_pct": (F.nullif("liq_px", F.lit(0.0)) - spot) / spot * 100,
                "total_spot_eth": held,
            }
        )
        .withColumn("hedge_ratio", F.when(short, ratio))
        .withColumn(
            "hedge_label",
            ladder(
                (short & (F.col("hedge_ratio") >= HEDGE_FULL), "FULLY_HEDGED"),
                (short & (F.col("hedge_ratio") >= HEDGE_PARTIAL), "PARTIAL_HEDGE"),
                (~short & (F.col("total_spot_eth") >= F.col("size_eth") * DOUBLE_SPOT), "DOUBLE_BULL"),
                otherwise="DIRECTIONAL_BET",
            ),
        )
        .withColumn("wallet_short", F.concat(F.substring("wallet", 1, 6), F.lit("…"), F.right("wallet", F.lit(4))))
    )


def positions_summary(book: DataFrame) -> DataFrame:
    long = F.col("side") == "LONG"
    return book.agg(
        F.sum(F.when(long, F.col("size_usd")).otherwise(0.0)).alias("long_usd"),
        F.sum(F.when(long, 0.0).otherwise(F.col("size_usd"))).alias("short_usd"),
        F.count_if(long).alias("longs"),
        F.count_if(~long).alias("shorts"),
        F.count_distinct("wallet").alias("wallets"),
    ).withColumn("net_usd", F.col("long_usd") - F.col("short_usd"))


def positions_liq_bins(book: DataFrame, size: float = 25.0) -> DataFrame:
    return (
        book.filter("liq_px IS NOT NULL AND liq_px <> 0")
        .groupBy(bucket("liq_px", size).alias("price"), "side")
        .agg(F.sum("size_usd").alias("size_usd"), F.count(F.lit(1)).alias("n"))
    )


def spot_roster(positions: DataFrame, spot: float) -> DataFrame:
    """Wallets holding the spot token, with or without a position."""
    return positions.filter("spot_eth > 0").select(
        "wallet", "spot_eth", (F.col("spot_eth") * spot).alias("spot_usd")
    )


def spot_without_perp(positions: DataFrame, book: DataFrame, spot: float) -> DataFrame:
    return spot_roster(positions, spot).join(book.select("wallet"), "wallet", "left_anti")


# Leverage tier -> assumed share of open interest.
LEVERAGE_TIERS = {2: 0.05, 3: 0.08, 5: 0.15, 10: 0.25, 20: 0.22, 25: 0.12, 50: 0.08, 75: 0.03, 100: 0.02}


def liq_map(open_interest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Liquidation prices per leverage tier and side from ``oi_usd spot rate``; funding tilts the long share."""
    tiers = F.array(*[F.struct(F.lit(k).alias("leverage"), F.lit(v).alias("share")) for k, v in LEVERAGE_TIERS.items()])
    bias = clamp(0.5 + F.coalesce("rate", F.lit(0.0)) * 5000, 0.3, 0.7)
    step = 0.8 / F.col("leverage")
    base = (
        open_interest.filter("oi_usd > 0 AND spot > 0")
        .withColumn("bias", bias)
        .select("*", F.inline(tiers))
        .withColumn("tier_usd", F.col("oi_usd") * F.col("share"))
    )
    sides = F.array(
        F.struct(F.lit("long").alias("side"), (F.col("spot") * (1 - step)).alias("liq_px"),
                 (F.col("tier_usd") * F.col("bias")).alias("usd"), (-100 * step).alias("pct")),
        F.struct(F.lit("short").alias("side"), (F.col("spot") * (1 + step)).alias("liq_px"),
                 (F.col("tier_usd") * (1 - F.col("bias"))).alias("usd"), (100 * step).alias("pct")),
    )
    return base.select(*keys, "leverage", F.inline(sides))


def liq_map_summary(liq: DataFrame, keys: Sequence[str]) -> DataFrame:
    near = F.abs("pct") < 5
    return liq.groupBy(*keys, "side").agg(
        F.sum("usd").alias("total_usd"),
        F.max_by(F.when(near, F.col("liq_px")), F.when(near, F.struct("usd", -F.col("leverage")))).alias("nearest_px"),
        F.max(F.when(near, F.col("usd"))).alias("nearest_usd"),
    )


def funding_spread(rates: DataFrame) -> DataFrame:
    """Across venues at one time; a time needs two venues. Ties go to the first venue by name."""
    v = F.col("venue")
    return (
        rates.groupBy("ts")
        .agg(
            F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate"), F.avg("rate").alias("mean_rate"),
            F.min(F.struct((-F.col("rate")).alias("r"), v.alias("v")))["v"].alias("max_venue"),
            F.min(F.struct(F.col("rate").alias("r"), v.alias("v")))["v"].alias("min_venue"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n >= 2")
        .withColumn("spread", F.col("max_rate") - F.col("min_rate"))
    )


def funding_level(rate) -> Column:
    r = F.col(rate)
    return ladder(
        (r.isNull(), "UNKNOWN"), (r >= 0.0003, "HIGH"), (r <= -0.0001, "NEGATIVE"), (r <= 0.00005, "LOW"), otherwise="NORMAL"
    )


def futures_basis(futures: DataFrame, keys: Sequence[str], as_of: Column, spot: float) -> DataFrame:
    """Basis of each dated future against the spot; ``rank`` 1 is the front, ``term_mid`` the mean of the first three."""
    dte = (F.unix_seconds("expiry") + 8 * 3600 - F.unix_seconds(as_of)) / 86400
    w = Window.partitionBy(*keys)
    return (
        futures.withColumn("dte", dte)
        .filter("dte > 0 AND mark IS NOT NULL AND mark <> 0")
        .withColumns({"basis_abs": F.col("mark") - spot, "basis_pct": (F.col("mark") - spot) / spot * 100})
        .withColumns(
            {
                "basis_ann": F.col("basis_pct") * (365.0 / F.col("dte")),
                "rank": F.row_number().over(w.orderBy("dte")),
                "__n": F.count(F.lit(1)).over(w),
            }
        )
        .withColumn("term_mid", F.when(F.col("__n") >= 3, F.avg(F.when(F.col("rank") <= 3, F.col("basis_ann"))).over(w)))
        .drop("__n")
    )


def perp_basis(perps: DataFrame, keys: Sequence[str], front: DataFrame | None = None) -> DataFrame:
    """``venue perp spot`` per key: spread to spot, its range over venues, and the front future against the mean perp."""
    w = Window.partitionBy(*keys)
    rows = perps.filter("perp > 0 AND spot > 0").withColumns(
        {"spread": F.col("perp") - F.col("spot"), "basis_pct": (F.col("perp") - F.col("spot")) / F.col("spot") * 100}
    )
    rows = rows.withColumns(
        {"max_spread": F.max("spread").over(w), "min_spread": F.min("spread").over(w), "perp_avg": F.avg("perp").over(w)}
    )
    if front is None:
        return rows
    q = div(F.col("mark") - F.col("perp_avg"), "perp_avg") * 100
    return rows.join(front, list(keys), "left").withColumns({"q_pct": q, "q_ann": q * (365.0 / F.col("dte"))})


def venue_totals(rows: DataFrame, keys: Sequence[str], steps: int = 48) -> DataFrame:
    """Sums over venues per time, each venue's share, and the change over 48 steps (or since the first row)."""
    keys = list(keys)
    in_usd = F.when(F.col("unit") == "coin", F.col("oi") * F.col("px")).otherwise(F.col("oi"))
    usd = rows.withColumn("oi_usd", in_usd)
    total = usd.groupBy(*keys, "ts").agg(
        F.sum("oi_usd").alias("total_oi"), F.sum("volume_usd").alias("total_volume"),
        F.max("oi_usd").alias("top_oi"), F.min(F.struct((-F.col("oi_usd")).alias("o"), F.col("venue").alias("v")))["v"].alias("top_venue"),
    )
    firsts = total.groupBy(*keys).agg(F.min_by("total_oi", "ts").alias("first_oi"))

    def add(r, w):
        return r.withColumn("past_oi", F.lag("total_oi", steps).over(w))

    out = row_frames(total, keys, ["ts"], add, back=steps, keep_number=True).join(firsts, keys)
    past = F.coalesce("past_oi", "first_oi")
    return out.withColumns(
        {
            "top_share": div(F.col("top_oi") * 100, F.col("total_oi")),
            "oi_chg_pct": F.when((F.col("__rn") >= 2) & (past != 0), (F.col("total_oi") - past) / past * 100),
        }
    ).drop("past_oi", "first_oi", "__rn", "__n")


# -- long/short ratios ---------------------------------------------------------------------------------------------


def ls_latest(ls: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ls.groupBy(*keys).agg(F.max_by(F.struct("ts", "ratio", "long_pct"), "ts").alias("x")).select(*keys, "x.*")


def ls_aligned(ls: DataFrame, venues: Sequence[str], tolerance_s: float) -> DataFrame:
    """For every time any venue reports, each venue's nearest value within the tolerance."""
    rows = ls.filter(F.col("venue").isin(*venues))
    times = rows.select("ts").distinct()
    return nearest_join(times, rows, [], ["ts"], "long_pct", tolerance_s, extra_keys=["venue"], how="matches")


def ls_aggregate(ls: DataFrame, venues: Sequence[str], tolerance_s: float) -> DataFrame:
    """Mean long share over the venues at every time any of them reports."""
    lp = F.col("long_pct")
    return (
        ls_aligned(ls, venues, tolerance_s)
        .groupBy("ts")
        .agg(F.avg("long_pct").alias("long_pct"), F.count(F.lit(1)).alias("venues"))
        .withColumn("ratio", F.when(lp < 1, lp / (1 - lp)))
    )


def ls_deltas(ls: DataFrame, keys: Sequence[str], hours: Sequence[int] = (1, 4, 24)) -> DataFrame:
    """Change of the long share over n hours per row; where history is too short, since the oldest row."""
    keys = list(keys)
    rows = ls.select(*keys, "ts", "long_pct").withColumn("h", F.explode(F.array(*[F.lit(h) for h in hours])))
    rows = rows.withColumn("__t", F.timestamp_micros(F.unix_micros("ts") - F.col("h") * F.lit(3_600_000_000)))
    past = ls.select(*keys, "ts", F.col("long_pct").alias("past"))
    found = asof_join(rows, past, keys, ["past"], left_ts="__t")
    first = ls.groupBy(*keys).agg(F.min_by("long_pct", "ts").alias("oldest"), F.min("ts").alias("t0"))
    return (
        found.join(first, keys)
        .withColumn(
            "delta", F.when(F.col("ts") > F.col("t0"), F.col("long_pct") - F.coalesce("past", "oldest"))
        )
        .select(*keys, "ts", "h", "long_pct", "delta")
    )


def ls_divergence(ls: DataFrame, retail: Sequence[str], whale: str, tolerance_s: float) -> DataFrame:
    """Retail minus whale long share: the series, with the latest value scored against all before it.

    The score needs twelve earlier values; only the newest row of the series is scored.
    """
    agg = ls_aggregate(ls, retail, tolerance_s).select("ts", F.col("long_pct").alias("retail"))
    whales = ls.filter(F.col("venue") == whale).select("ts", F.col("long_pct").alias("whale"))
    agg = settle(agg)  # read for the match and for its result, as is the series below
    series = settle(
        nearest_join(agg, whales, [], ["ts"], "whale", 1800).filter("whale IS NOT NULL").select(
            "ts", (F.col("retail") - F.col("whale")).alias("value")
        )
    )
    last = series.agg(F.max(F.struct("ts", "value"))).scalar()
    hist = series.withColumn("__l", last).withColumns({"now_ts": F.col("__l.ts"), "now": F.col("__l.value")}).filter("ts < now_ts")
    n, sd = F.col("n"), F.col("sd")
    return (
        hist.groupBy("now_ts", "now")
        .agg(
            F.count("value").alias("n"), F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"),
            F.count_if(F.col("value") <= F.col("now")).alias("below"),
        )
        .withColumns(
            {
                "z": F.when((n >= 12) & (sd > 0), (F.col("now") - F.col("mu")) / sd),
                "percentile": F.when(n >= 12, F.col("below") / n * 100),
            }
        )
    )


def confluence_reading(whale, flow, level) -> Column:
    """Whale side, flow direction and funding level to one reading; first match wins."""
    w, f, g = F.col(whale), F.col(flow), F.col(level)
    return ladder(
        ((w == "LONG") & (f == "BULLISH") & g.isin("NORMAL", "LOW"), "CONFIRMED_BULL"),
        ((w == "SHORT") & (f == "BEARISH"), "CONFIRMED_BEAR"),
        ((w == "LONG") & (f == "BEARISH") & (g == "HIGH"), "DIVERGENT_WHALE_WRONG_SIDE"),
        ((w == "SHORT") & (f == "BULLISH"), "DIVERGENT_WHALE_WRONG_SIDE"),
        ((w == "LONG") & (g == "HIGH"), "OVERHEATED_LONG"),
        ((w == "SHORT") & (g == "NEGATIVE"), "OVERHEATED_SHORT"),
        (w == "NEUTRAL", "WHALES_UNDECIDED"),
        otherwise="MIXED",
    )


def whale_side(ratio) -> Column:
    r = F.col(ratio)
    return ladder((r >= 1.15, "LONG"), (r <= 0.87, "SHORT"), otherwise="NEUTRAL")


# Assumed split of open interest between cohorts.
COHORTS = {"whale": 0.75, "retail": 0.25}


def cohort_exposure(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long, short and net USD per cohort from ``oi_usd`` and the cohort's long share (``whale_lp``, ``retail_lp``)."""
    parts = F.array(
        *[
            F.struct(F.lit(n).alias("cohort"), (F.col("oi_usd") * s).alias("cohort_oi"), F.col(f"{n}_lp").alias("long_pct"))
            for n, s in COHORTS.items()
        ]
    )
    o, lp = F.col("cohort_oi"), F.col("long_pct")
    return rows.select(*keys, F.inline(parts)).withColumns(
        {"long_usd": o * lp, "short_usd": o * (1 - lp), "net_usd": o * lp - o * (1 - lp)}
    )


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar expressions as temporary SQL functions, defined by SQL bodies (no Python at run time)."""
    body = {
        "tm_bucket(x DOUBLE, size DOUBLE) RETURNS DOUBLE": "rint(x / size) * size",
        "tm_flow_direction(z DOUBLE, net DOUBLE, mean DOUBLE) RETURNS STRING": """
            CASE WHEN abs(z) >= 1 THEN CASE WHEN z > 0 THEN 'BEARISH' ELSE 'BULLISH' END
                 WHEN net < -greatest(abs(mean), 500D) THEN 'BULLISH'
                 WHEN net > greatest(abs(mean), 500D) THEN 'BEARISH' ELSE 'NEUTRAL' END""",
        "tm_bs_gamma(s DOUBLE, k DOUBLE, t DOUBLE, sigma DOUBLE, r DOUBLE) RETURNS DOUBLE": """
            CASE WHEN s > 0 AND k > 0 AND t > 0 AND sigma > 0 THEN
              exp(-0.5D * pow((ln(s / k) + (r + 0.5D * sigma * sigma) * t) / (sigma * sqrt(t)), 2D))
              / sqrt(2D * pi()) / (s * sigma * sqrt(t)) ELSE 0D END""",
    }
    for head, text in body.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {text}")
    from ..functions.exprs import CDF_DEN, CDF_NUM

    def poly(coeffs):
        text = f"{coeffs[0]!r}D" if "e" not in repr(coeffs[0]) else f"CAST('{coeffs[0]!r}' AS DOUBLE)"
        for k in coeffs[1:]:
            text = f"({text}) * abs(x) + {k!r}D"
        return text

    # the same three branches as functions.exprs.norm_cdf
    density = "exp(-abs(x) * abs(x) / 2)"
    near = f"{density} * ({poly(CDF_NUM)}) / ({poly(CDF_DEN)})"
    far = f"{density} / (abs(x) + 1 / (abs(x) + 2 / (abs(x) + 3 / (abs(x) + 4 / (abs(x) + 0.65D))))) / 2.506628274631D"
    tail = f"CASE WHEN abs(x) > 37 THEN 0D WHEN abs(x) < 7.07106781186547D THEN {near} ELSE {far} END"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tm_norm_cdf(x DOUBLE) RETURNS DOUBLE RETURN "
        f"CASE WHEN x > 0 THEN 1D - ({tail}) ELSE {tail} END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tm_bs_delta(s DOUBLE, k DOUBLE, t DOUBLE, r DOUBLE, sigma DOUBLE, is_call BOOLEAN) "
        "RETURNS DOUBLE RETURN CASE WHEN s > 0 AND k > 0 AND t > 0 AND sigma > 0 THEN "
        "tm_norm_cdf((ln(s / k) + (r + 0.5D * sigma * sigma) * t) / (sigma * sqrt(t))) - CASE WHEN is_call THEN 0D ELSE 1D END "
        "ELSE 0D END"
    )
