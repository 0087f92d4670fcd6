"""Venue flows per time bucket: windows, context against history, and transfer classification.

``flows`` has one row per key, venue and bucket: ``cex ts inflow outflow net net_usd tx``. The newest bucket may still
be filling; it counts as provisional when the data was read less than ``lag_s`` after its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div, ladder
from ..plans.ordered import row_frames, top_k

LAG_S = 90 * 60


def fill_usd(flows: DataFrame, price: float) -> DataFrame:
    """A missing USD value falls back to the net amount at the given price."""
    return flows.withColumn("net_usd", F.coalesce("net_usd", F.col("net") * price))


def late_bucket(flows: DataFrame, keys: Sequence[str], bucket_s: int, age_s: int, lag_s: int = LAG_S) -> DataFrame:
    """Per key the newest bucket, whether it is provisional, and the newest settled bucket.

    ``age_s`` is the age of the newest bucket's end when the data was read. A single bucket is never provisional.
    """
    stamps = flows.groupBy(*keys, "ts").agg(F.sum("tx").alias("tx"))
    top = top_k(stamps, keys, [F.desc("ts")], 2)
    partial = F.lit(age_s < lag_s) & (F.count(F.lit(1)) > 1)
    return top.groupBy(*keys).agg(
        F.max("ts").alias("max_ts"),
        partial.alias("is_partial"),
        F.when(partial, F.min("ts")).otherwise(F.max("ts")).alias("settled_ts"),
    )


def flow_windows(
    flows: DataFrame, keys: Sequence[str], windows: dict[str, int], bucket_s: int, age_s: int, volumes: dict[str, float]
) -> DataFrame:
    """Sums over the last n buckets; only the shortest window leaves the provisional bucket out.

    Rows are marked with the windows they fall in and summed once. The table of newest buckets has one row per key.
    """
    keys = list(keys)
    rows = flows.join(late_bucket(flows, keys, bucket_s, age_s), keys)
    shortest = min(windows, key=windows.get)
    marks = []
    for name, n in windows.items():
        anchor = F.col("settled_ts") if name == shortest else F.col("max_ts")
        cutoff = F.unix_seconds(anchor) - (n - 1) * bucket_s
        inside = (F.unix_seconds("ts") >= cutoff) & (F.col("ts") <= anchor)
        part = F.lit(name != shortest) & F.col("is_partial")
        vol = F.lit(volumes.get(name)).cast("double")
        marks.append(
            F.when(inside, F.struct(F.lit(name).alias("win"), part.alias("includes_partial"), vol.alias("volume_usd")))
        )
    out = (
        rows.select(*keys, "inflow", "outflow", "net", "net_usd", "tx", F.inline(F.array_compact(F.array(*marks))))
        .groupBy(*keys, "win", "includes_partial", "volume_usd")
        .agg(*[F.sum(x).alias(x) for x in ("inflow", "outflow", "net", "net_usd", "tx")])
    )
    return out.withColumn("flow_vol_pct", F.when(F.col("volume_usd") > 0, F.abs("net_usd") / F.col("volume_usd") * 100))


def flow_by_venue(flows: DataFrame, keys: Sequence[str], bucket_s: int, n: int = 24) -> DataFrame:
    """Sums per venue over the last n buckets, largest withdrawals first (``rank``)."""
    last = flows.groupBy(*keys).agg(F.max("ts").alias("max_ts"))
    rows = flows.join(last, list(keys)).filter(
        F.unix_seconds("ts") >= F.unix_seconds("max_ts") - (n - 1) * bucket_s
    )
    return rows.groupBy(*keys, "cex").agg(*[F.sum(x).alias(x) for x in ("inflow", "outflow", "net", "net_usd", "tx")])


def flow_totals(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return flows.groupBy(*keys, "ts").agg(*[F.sum(x).alias(x) for x in ("net", "net_usd", "tx")])


def rolling_flow_z(flows: DataFrame, keys: Sequence[str], bucket_s: int, n: int = 24, floor: float = 500.0) -> DataFrame:
    """Net flow of the last n buckets' time against the history of n-row sums (the newest sum left out).

    With fewer than 24 sums the z-score is 0 and the percentile 50. A calm history is floored at ``floor``.
    """
    keys = list(keys)
    totals = flow_totals(flows, keys)

    def add(rows, w):
        f = w.rowsBetween(-(n - 1), 0)
        return rows.withColumn("sum_n", F.when(F.col("__rn") >= n, F.sum("net").over(f)))

    sums = row_frames(totals, keys, ["ts"], add, back=n, keep_number=True).select(*keys, "sum_n", "__rn", "__n")
    last = totals.groupBy(*keys).agg(F.max("ts").alias("max_ts"))
    recent = (
        totals.join(last, keys)
        .filter(F.unix_seconds("ts") >= F.unix_seconds("max_ts") - (n - 1) * bucket_s)
        .groupBy(*keys)
        .agg(F.sum("net").alias("net"), F.sum("net_usd").alias("net_usd"))
    )
    # with a single sum, the reference distribution is that sum itself
    past = (F.col("__rn") < F.col("__n")) | (F.col("__n") == n)
    hist = sums.filter(F.col("sum_n").isNotNull() & past).join(recent, keys)
    enough = F.col("samples") >= 24
    return (
        hist.groupBy(*keys, "net", "net_usd")
        .agg(
            F.count("sum_n").alias("samples"), F.avg("sum_n").alias("mean"),
            F.coalesce(F.stddev_samp("sum_n"), F.lit(0.0)).alias("std"),
            F.count_if(F.col("sum_n") <= F.col("net")).alias("below"),
        )
        .withColumns(
            {
                "z": F.when(enough, (F.col("net") - F.col("mean")) / F.greatest("std", F.lit(floor))).otherwise(0.0),
                "percentile": F.when(enough, F.col("below") / F.col("samples") * 100).otherwise(50.0),
            }
        )
        .withColumn("magnitude", magnitude(enough, F.abs("z")))
        .drop("below")
    )


def magnitude(reliable: Column, z: Column) -> Column:
    return F.when(~reliable, "NOISE").otherwise(
        ladder((z >= 2.0, "EXTREME"), (z >= 1.0, "ELEVATED"), (z >= 0.3, "NORMAL"), otherwise="NOISE")
    )


def flow_direction(scored: DataFrame, price_chg_pct: Column) -> DataFrame:
    """Direction by z-score when it is large, by a band around zero otherwise; divergence from price; bias."""
    z, net = F.col("z"), F.col("net")
    band = F.greatest(F.abs("mean"), F.lit(500.0))
    direction = ladder(
        ((F.abs(z) >= 1) & (z > 0), "BEARISH"), (F.abs(z) >= 1, "BULLISH"),
        (net < -band, "BULLISH"), (net > band, "BEARISH"), otherwise="NEUTRAL",
    )
    d, p = F.col("direction"), F.col("price_chg_pct")
    agrees = ((d == "BULLISH") & (p > 0.5)) | ((d == "BEARISH") & (p < -0.5))
    return scored.withColumns({"direction": direction, "price_chg_pct": price_chg_pct}).withColumns(
        {
            "divergence": F.when(p.isNull() | (d == "NEUTRAL"), F.lit(None)).otherwise(
                ladder((p.between(-0.5, 0.5), "FLAT_PRICE"), (agrees, "CONFIRMED"), otherwise="DIVERGENT")
            ),
            "bias": ladder(
                (d == "NEUTRAL", "NEUTRAL"), (F.col("magnitude").isin("EXTREME", "ELEVATED"), d),
                otherwise=F.concat(d, F.lit("_MILD")),
            ),
        }
    )


def flow_labels(scored: DataFrame) -> DataFrame:
    """Plain words for the percentile and for flow against volume (``flow_vol_pct``)."""
    p, r = F.col("percentile"), F.col("flow_vol_pct")
    return scored.withColumns(
        {
            "pct_label": F.when(
                p.isNotNull(),
                # fixed values: limits and labels
                ladder((p < 10, "más bullish que casi todas"), (p > 90, "más bearish que casi todas"), otherwise="rango típico"),
            ),
            "vol_label": F.when(r.isNotNull(), ladder((r >= 5, "material"), (r >= 1, "perceptible"), otherwise="marginal")),
        }
    )


# -- transfers ---------------------------------------------------------------------------------------------------


def tag_sides(transfers: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """``src_<set>`` and ``dst_<set>``: is that end in the address set?

    All sets become one table of marks, so there is one join per end. Spark broadcasts the table while it is small;
    beyond that a wallet with most of the transfers is split by adaptive skew handling, as the left side of a left join.
    """
    marks = None
    for name, ids in sets.items():
        one = ids.select("address", *[F.lit(n == name).alias(n) for n in sets])
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.groupBy("address").agg(*[F.bool_or(n).alias(n) for n in sets])
    for end in ("src", "dst"):
        side = marks.select(F.col("address").alias(end), *[F.col(n).alias(f"{end}_{n}") for n in sets])
        transfers = transfers.join(side, end, "left").na.fill(False, [f"{end}_{n}" for n in sets])
    return transfers


def drop_internal(tagged: DataFrame, min_value: float = 0.0) -> DataFrame:
    """Transfers between a tracked address and another of the same owner are not flow."""
    inner = (F.col("dst_tracked") & F.col("src_own")) | (F.col("src_tracked") & F.col("dst_own"))
    return tagged.filter(~inner & (F.col("value") >= min_value))


def drop_mint_burn(transfers: DataFrame, contract: str, zero: str) -> DataFrame:
    """Leave out minting, burning and moves of the token contract itself."""
    return transfers.filter(~F.col("src").isin(contract, zero) & ~F.col("dst").isin(contract, zero))


def flow_onchain_hourly(tagged: DataFrame, bucket: str = "hour") -> DataFrame:
    """Inflow to and outflow from tracked addresses per hour."""
    v = F.col("value")
    return (
        tagged.groupBy(F.date_trunc(bucket, "ts").alias("ts"))
        .agg(
            F.sum(F.when(F.col("dst_tracked"), v).otherwise(0.0)).alias("inflow"),
            F.sum(F.when(F.col("src_tracked"), v).otherwise(0.0)).alias("outflow"),
            F.count(F.lit(1)).alias("tx"),
        )
        .withColumn("net", F.col("inflow") - F.col("outflow"))
    )


def flow_issuance_daily(transfers: DataFrame, treasury: str) -> DataFrame:
    """Issued, redeemed and net amount per day for one treasury address."""
    v = F.col("value")
    return (
        transfers.groupBy(F.date_trunc("day", "ts").alias("day"))
        .agg(
            F.sum(F.when(F.col("src") == treasury, v).otherwise(0.0)).alias("issuance"),
            F.sum(F.when(F.col("dst") == treasury, v).otherwise(0.0)).alias("redemption"),
        )
        .withColumn("net", F.col("issuance") - F.col("redemption"))
    )


# -- reserves, supply, funds, macro (one row per series and day or month: plain windows over a calendar) -----------


# Symbols counted as one token family.
ETH_FAMILY = ["ETH", "WETH", "STETH", "BETH", "CBETH", "EETH", "WEETH", "RETH"]
STABLE_FAMILY = ["USDT", "USDC", "DAI", "FDUSD", "BUSD", "TUSD", "USDD", "PYUSD", "USDE"]


def family_sum(tokens: str, family: Sequence[str]) -> Column:
    picked = F.map_filter(tokens, lambda k, v: F.upper(k).isin(*family))
    return F.aggregate(F.map_values(picked), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def token_map(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumns({"eth": family_sum("tokens", ETH_FAMILY), "stable": family_sum("tokens", STABLE_FAMILY)})


def reserves_daily(balances: DataFrame) -> DataFrame:
    """Sums over venues per date where at most one venue is missing; a venue's first row of a date counts."""
    first = balances.groupBy("venue", F.to_date("ts").alias("day")).agg(
        F.min_by(F.struct("eth", "stable"), "ts").alias("x")
    )
    venues = balances.agg(F.count_distinct("venue")).scalar()
    return (
        first.groupBy("day")
        .agg(F.sum("x.eth").alias("eth"), F.sum("x.stable").alias("stable"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.greatest(F.lit(1), venues - 1))
    )


def reserves_vs_avg(daily: DataFrame, balances: DataFrame, as_of: Column, windows: Sequence[int]) -> DataFrame:
    """Latest totals against their mean over the last n days."""
    latest = balances.groupBy("venue").agg(F.max_by(F.struct("eth", "stable"), "ts").alias("x"))
    now = latest.agg(F.struct(F.sum("x.eth").alias("eth"), F.sum("x.stable").alias("stable"))).scalar()
    eth, stable = now["eth"], now["stable"]
    marks = [F.when(F.col("day") >= F.date_sub(F.to_date(as_of), n), F.lit(n)) for n in windows]
    return (
        daily.withColumn("days", F.explode(F.array_compact(F.array(*marks))))
        .groupBy("days")
        .agg(F.avg("eth").alias("avg_eth"), F.avg("stable").alias("avg_stable"), F.count(F.lit(1)).alias("samples"))
        .withColumns(
            {
                "eth_pct": F.when(F.col("avg_eth") > 0, (eth - F.col("avg_eth")) / F.col("avg_eth") * 100).otherwise(0.0),
                "stable_pct": F.when(
                    F.col("avg_stable") > 0, (stable - F.col("avg_stable")) / F.col("avg_stable") * 100
                ).otherwise(0.0),
            }
        )
    )


def reserve_narrative(eth, stable) -> Column:
    e, s = F.col(eth), F.col(stable)
    return F.when(
        e.isNotNull() & s.isNotNull(),
        ladder(
            # fixed values: limits and labels
            ((e < -1) & (s > 1), "ACUMULACION PROBABLE"), ((e > 1) & (s < -1), "DISTRIBUCION PROBABLE"),
            ((e > 1) & (s > 1), "CAPITALIZACION"), ((e < -1) & (s < -1), "DESAPALANCAMIENTO"), otherwise="NEUTRAL",
        ),
    )


def category_rollup(rows: DataFrame, category: str, amounts: Sequence[str]) -> DataFrame:
    """Amounts per category with the grand total as the row whose category is null."""
    return rows.rollup(category).agg(*[F.sum(a).alias(a) for a in amounts], F.count(F.lit(1)).alias("n"))


def etf_rolling(totals: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Sum, mean and signs of the last n daily totals, with a flag for missing ones."""

    def add(rows, w):
        f, t = w.rowsBetween(-(n - 1), 0), F.col("total")
        return rows.withColumns(
            {
                "sum": F.sum(t).over(f), "avg": F.avg(t).over(f), "pos": F.count_if(t > 0).over(f),
                "neg": F.count_if(t < 0).over(f), "nulls": F.count_if(t.isNull()).over(f),
            }
        ).withColumn("full", F.col("__rn") >= n)

    rows = row_frames(totals, keys, ["day"], add, back=n)
    return rows.filter("full").withColumn("has_gaps", F.col("nulls") > 0).drop("full")


def step_deltas(series: DataFrame, keys: Sequence[str], value: str, steps: Sequence[int]) -> DataFrame:
    """Absolute and percent change over n rows."""

    def add(rows, w):
        cols = {}
        for n in steps:
            past = F.lag(value, n).over(w)
            cols[f"abs_{n}"] = F.col(value) - past
            cols[f"pct_{n}"] = F.when(past > 0, (F.col(value) / past - 1) * 100)
        return rows.withColumns(cols)

    return row_frames(series, keys, ["ts"], add, back=max(steps))


def macro_changes(series: DataFrame, keys: Sequence[str], n_vol: int = 20) -> DataFrame:
    """1, 5 and 21-row percent changes and 20-row annual volatility (ten returns at least). Rows, not days."""

    def add(rows, w):
        cols = {}
        for n in (1, 5, 21):
            past = F.lag("close", n).over(w)
            cols[f"chg_{n}"] = F.when(past > 0, (F.col("close") / past - 1) * 100)
        prev = F.lag("close").over(w)
        rows = rows.withColumns(cols).withColumn(
            "__r", F.when((prev > 0) & (F.col("close") > 0), F.log(F.col("close") / prev))
        )
        f = w.rowsBetween(-(n_vol - 1), 0)
        vol = F.stddev_samp("__r").over(f) * F.sqrt(F.lit(252.0))
        ok = (F.col("__rn") > n_vol) & (F.count("__r").over(f) >= 10)
        return rows.withColumn("vol", F.when(ok, vol)).drop("__r")

    return row_frames(series.filter("close IS NOT NULL"), keys, ["ts"], add, back=n_vol + 22)


def capital_share(cex: DataFrame, defi: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of two pools (``cex``, ``defi`` columns) in their sum."""
    both = cex.join(defi, list(keys))
    total = F.col("cex") + F.col("defi")
    return both.withColumns(
        {
            "cex_pct": F.when(total > 0, F.col("cex") / total * 100).otherwise(0.0),
            "defi_pct": F.when(total > 0, F.col("defi") / total * 100).otherwise(0.0),
        }
    )
