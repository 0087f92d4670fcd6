from pyspark.sql import functions as F

from ..operators import flows as op
from ..sources.views import SPOT, Views
from .registry import query
from .views import VIEWS

DAY = 86400
WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168}  # the fixture's bucket is a day
VOLUMES = {"1h": 1e6, "6h": 6e6, "24h": 2.4e7, "7d": 1.68e8}
AGE = 30 * 60

VIEWS["fl"] = "SELECT * REPLACE (coalesce(net_usd, net * 1500.0e0) AS net_usd) FROM flows"
VIEWS["fl_max"] = """
  SELECT asset, max(ts) AS max_ts, max(CASE WHEN r = 2 THEN ts END) AS second_ts, max(r) > 1 AS is_partial FROM (
    SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS r FROM (SELECT DISTINCT asset, ts FROM fl)) GROUP BY asset"""
VIEWS["fl_win"] = " UNION ALL ".join(
    f"""SELECT asset, '{n}' AS win, {"false" if n == "1h" else "any_value(is_partial)"} AS includes_partial, {VOLUMES[n]:.0f}::DOUBLE AS volume_usd,
          sum(inflow) AS inflow, sum(outflow) AS outflow, sum(net) AS net, sum(net_usd) AS net_usd, sum(tx) AS tx
        FROM fl JOIN fl_max USING (asset)
        WHERE ts >= {"coalesce(second_ts, max_ts)" if n == "1h" else "max_ts"} - INTERVAL {k - 1} DAY
          AND ts <= {"coalesce(second_ts, max_ts)" if n == "1h" else "max_ts"} GROUP BY asset"""
    for n, k in WINDOWS.items()
)
FLOW = "inflow:f2 outflow:f2 net:f2 net_usd:f2 tx:i"


def fl(v: Views):
    return op.fill_usd(v.flows(), SPOT)


@query(
    "flow_windows",
    f"asset win includes_partial volume_usd:f2 {FLOW} flow_vol_pct:f9",
    "SELECT *, abs(net_usd) / volume_usd * 100 AS flow_vol_pct FROM fl_win",
)
def _(spark, d):
    return op.flow_windows(op.fill_usd(Views(spark, d).kept("flows"), SPOT), ["asset"], WINDOWS, DAY, AGE, VOLUMES)


@query(
    "st_late_bucket",
    "asset max_ts:t is_partial settled_ts:t",
    "SELECT asset, max_ts, is_partial, coalesce(second_ts, max_ts) AS settled_ts FROM fl_max",
)
def _(spark, d):
    return op.late_bucket(Views(spark, d).flows(), ["asset"], DAY, AGE)


@query(
    "flow_by_venue",
    f"asset cex {FLOW}",
    """SELECT asset, cex, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(net) AS net, sum(net_usd) AS net_usd, sum(tx) AS tx
       FROM fl JOIN fl_max USING (asset) WHERE ts >= max_ts - INTERVAL 23 DAY GROUP BY asset, cex""",
)
def _(spark, d):
    return op.flow_by_venue(fl(Views(spark, d)), ["asset"], DAY)


VIEWS["fl_tot"] = "SELECT asset, ts, sum(net) AS net, sum(net_usd) AS net_usd, sum(tx) AS tx FROM fl GROUP BY asset, ts"


@query("flow_hourly", "asset ts:t net:f2 net_usd:f2 tx:i", "SELECT * FROM fl_tot")
def _(spark, d):
    return op.flow_totals(fl(Views(spark, d)), ["asset"])


VIEWS["fl_z"] = """
  SELECT *, CASE WHEN samples < 24 THEN 'NOISE' WHEN abs(z) >= 2 THEN 'EXTREME' WHEN abs(z) >= 1 THEN 'ELEVATED'
                 WHEN abs(z) >= 0.3 THEN 'NORMAL' ELSE 'NOISE' END AS magnitude
  FROM (SELECT *, CASE WHEN samples >= 24 THEN (net - mean) / greatest(std, 500) ELSE 0 END AS z,
               CASE WHEN samples >= 24 THEN below * 100.0e0 / samples ELSE 50 END AS percentile
        FROM (SELECT asset, c.net, c.net_usd, count(*) AS samples, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS std,
                     count_if(s <= c.net) AS below
              FROM (SELECT asset, sum(net) OVER (PARTITION BY asset ORDER BY ts ROWS 23 PRECEDING) AS s,
                           row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn, count(*) OVER (PARTITION BY asset) AS n FROM fl_tot)
              JOIN (SELECT asset, sum(net) AS net, sum(net_usd) AS net_usd FROM fl_tot JOIN fl_max USING (asset)
                    WHERE ts >= max_ts - INTERVAL 23 DAY GROUP BY asset) c USING (asset)
              WHERE rn >= 24 AND (rn < n OR n = 24) GROUP BY ALL))"""
Z = "asset net:f2 samples:i mean:f6 std:f6 z:f9 percentile:f6 magnitude"


def scored(v: Views):
    return op.rolling_flow_z(op.fill_usd(v.kept("flows"), SPOT), ["asset"], DAY)


@query("rolling_flow_z", Z, "SELECT * FROM fl_z")
def _(spark, d):
    return scored(Views(spark, d))


VIEWS["fl_dir"] = """
  SELECT *, CASE WHEN p IS NULL OR direction = 'NEUTRAL' THEN NULL WHEN p BETWEEN -0.5e0 AND 0.5e0 THEN 'FLAT_PRICE'
                 WHEN (direction = 'BULLISH') = (p > 0) THEN 'CONFIRMED' ELSE 'DIVERGENT' END AS divergence,
         CASE WHEN direction = 'NEUTRAL' THEN 'NEUTRAL' WHEN magnitude IN ('EXTREME', 'ELEVATED') THEN direction
              ELSE concat(direction, '_MILD') END AS bias
  FROM (SELECT *, CASE WHEN abs(z) >= 1 THEN CASE WHEN z > 0 THEN 'BEARISH' ELSE 'BULLISH' END
                       WHEN net < -greatest(abs(mean), 500) THEN 'BULLISH' WHEN net > greatest(abs(mean), 500) THEN 'BEARISH'
                       ELSE 'NEUTRAL' END AS direction, CASE WHEN asset = 'a0' THEN 2.0e0 ELSE -2.0e0 END AS p FROM fl_z)"""


def directed(v: Views):
    return op.flow_direction(scored(v), F.when(F.col("asset") == "a0", 2.0).otherwise(-2.0))


@query("flow_direction", "asset z:f9 direction divergence bias", "SELECT * FROM fl_dir")
def _(spark, d):
    return directed(Views(spark, d))


@query(
    "flow_labels",
    "asset percentile:f6 flow_vol_pct:f9 pct_label vol_label",
    """SELECT *, CASE WHEN percentile < 10 THEN 'más bullish que casi todas' WHEN percentile > 90 THEN 'más bearish que casi todas' ELSE 'rango típico' END AS pct_label,
              CASE WHEN flow_vol_pct >= 5 THEN 'material' WHEN flow_vol_pct >= 1 THEN 'perceptible' ELSE 'marginal' END AS vol_label
       FROM (SELECT *, abs(net_usd) / 2.4e7 * 100 AS flow_vol_pct FROM fl_z)""",
)
def _(spark, d):
    return op.flow_labels(scored(Views(spark, d)).withColumn("flow_vol_pct", F.abs("net_usd") / 2.4e7 * 100))


@query(
    "src_hourly_flows",
    "cex ts:t inflow:f2 outflow:f2 net:f2 net_usd:f2 tx:i",
    "SELECT * FROM fl",
)
def _(spark, d):
    from ..sources.payloads import hourly_flows

    v = Views(spark, d).flows()
    raw = v.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC")).alias("hour"),
        F.col("cex").alias("cex_name"), F.col("inflow").alias("inflow_eth"), F.col("outflow").alias("outflow_eth"),
        F.col("net").alias("net_inflow_eth"), F.col("net_usd").alias("net_inflow_usd"), F.col("tx").alias("tx_count"),
    )
    return hourly_flows(raw, SPOT)


VIEWS["res_d"] = """
  SELECT day, sum(eth) AS eth, sum(usdt) AS stable, count(*) AS n FROM (SELECT *, CAST(ts AS DATE) AS day FROM reserves)
  GROUP BY day HAVING count(*) >= greatest(1, (SELECT count(DISTINCT venue) FROM reserves) - 1)"""
VIEWS["res_now"] = """
  SELECT sum(eth) AS eth, sum(usdt) AS stable, count(*) AS venues FROM (SELECT * FROM reserves QUALIFY row_number() OVER (PARTITION BY venue ORDER BY ts DESC) = 1)"""
VIEWS["res_avg"] = """
  SELECT *, (eth - avg_eth) / avg_eth * 100 AS eth_pct, CASE WHEN avg_stable > 0 THEN (stable - avg_stable) / avg_stable * 100 ELSE 0 END AS stable_pct
  FROM (SELECT days, avg(eth) AS avg_eth, avg(stable) AS avg_stable, count(*) AS samples
        FROM res_d, (VALUES (90), (365), (730)) AS d(days) WHERE day >= DATE '2001-09-01' - days GROUP BY days), res_now"""


def balances(v: Views):
    return op.token_map(v.kept("reserves"))


def vs_avg(v: Views):
    b = balances(v)
    return op.reserves_vs_avg(op.reserves_daily(b), b, F.lit("2001-09-01").cast("timestamp"), [90, 365, 730])


@query("src_token_map", "venue ts:t eth:f2 stable:f2", "SELECT venue, ts, eth, usdt AS stable FROM reserves")
def _(spark, d):
    return balances(Views(spark, d))


@query("reserves_daily", "day:t eth:f2 stable:f2 n:i", "SELECT * FROM res_d")
def _(spark, d):
    return op.reserves_daily(balances(Views(spark, d)))


@query("reserves_vs_avg", "days:i avg_eth:f2 avg_stable:f2 samples:i eth_pct:f6 stable_pct:f6", "SELECT * FROM res_avg")
def _(spark, d):
    return vs_avg(Views(spark, d))


@query(
    "reserve_narrative",
    "days:i eth_pct:f6 stable_pct:f6 narrative",
    """SELECT *, CASE WHEN eth_pct < -1 AND stable_pct > 1 THEN 'ACUMULACION PROBABLE' WHEN eth_pct > 1 AND stable_pct < -1 THEN 'DISTRIBUCION PROBABLE'
              WHEN eth_pct > 1 AND stable_pct > 1 THEN 'CAPITALIZACION' WHEN eth_pct < -1 AND stable_pct < -1 THEN 'DESAPALANCAMIENTO'
              ELSE 'NEUTRAL' END AS narrative FROM res_avg""",
)
def _(spark, d):
    return vs_avg(Views(spark, d)).withColumn("narrative", op.reserve_narrative("eth_pct", "stable_pct"))


@query(
    "flow_vs_reserves",
    "asset net:f2 reserves_eth:f2 reserves_stable:f2 venues:i flow_pct:f9",
    """SELECT z.asset, z.net, r.eth AS reserves_eth, r.stable AS reserves_stable, c.venues, abs(z.net) / r.eth * 100 AS flow_pct
       FROM fl_z z JOIN (SELECT asset, count(DISTINCT cex) AS venues FROM fl GROUP BY asset) c USING (asset), res_now r""",
)
def _(spark, d):
    v = Views(spark, d)
    held = balances(v).groupBy("venue").agg(F.max_by(F.struct("eth", "stable"), "ts").alias("x"))
    now = held.agg(F.struct(F.sum("x.eth").alias("eth"), F.sum("x.stable").alias("stable"))).scalar()
    venues = v.kept("flows").groupBy("asset").agg(F.count_distinct("cex").alias("venues"))
    return (
        scored(v)
        .join(venues, "asset")
        .withColumn("now", now)
        .withColumns({"reserves_eth": F.col("now.eth"), "reserves_stable": F.col("now.stable")})
        .withColumn("flow_pct", F.when(F.col("reserves_eth") > 0, F.abs("net") / F.col("reserves_eth") * 100))
    )


@query(
    "category_rollup",
    "category eth:f2 usd:f2 n:i",
    """SELECT c_mktsegment AS category, sum(o_totalprice) / 1500 AS eth, sum(o_totalprice) AS usd, count(*) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)""",
)
def _(spark, d):
    v = Views(spark, d)
    rows = v.orders().join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("category"), (F.col("o_totalprice") / 1500).alias("eth"), F.col("o_totalprice").alias("usd")
    )
    return op.category_rollup(rows, "category", ["eth", "usd"])


@query(
    "capital_share",
    "ts:t cex:f2 defi:f2 cex_pct:f6 defi_pct:f6",
    """SELECT *, coalesce(cex / nullif(cex + defi, 0), 0) * 100 AS cex_pct, coalesce(defi / nullif(cex + defi, 0), 0) * 100 AS defi_pct FROM (
         SELECT ts, sum(CASE WHEN venue IN ('r0', 'r1') THEN eth END) AS cex, sum(CASE WHEN venue NOT IN ('r0', 'r1') THEN eth END) AS defi
         FROM reserves GROUP BY ts) WHERE cex IS NOT NULL AND defi IS NOT NULL""",
)
def _(spark, d):
    b = balances(Views(spark, d))
    part = lambda cond, name: b.filter(cond).groupBy("ts").agg(F.sum("eth").alias(name))
    is_cex = F.col("venue").isin("r0", "r1")
    return op.capital_share(part(is_cex, "cex"), part(~is_cex, "defi"), ["ts"])


STEPS = "abs_1:f2 pct_1:f6 abs_7:f2 pct_7:f6 abs_30:f2 pct_30:f6"
VIEWS["stab"] = """
  SELECT *, usd - lag(usd, 1) OVER w AS abs_1, usd - lag(usd, 7) OVER w AS abs_7, usd - lag(usd, 30) OVER w AS abs_30,
    CASE WHEN lag(usd, 1) OVER w > 0 THEN (usd / lag(usd, 1) OVER w - 1) * 100 END AS pct_1,
    CASE WHEN lag(usd, 7) OVER w > 0 THEN (usd / lag(usd, 7) OVER w - 1) * 100 END AS pct_7,
    CASE WHEN lag(usd, 30) OVER w > 0 THEN (usd / lag(usd, 30) OVER w - 1) * 100 END AS pct_30
  FROM (SELECT coalesce(venue, 'ALL') AS coin, ts, sum(usdt) AS usd FROM reserves GROUP BY GROUPING SETS ((venue, ts), (ts)))
  WINDOW w AS (PARTITION BY coin ORDER BY ts)"""


def supply(v: Views):
    """Supply per coin and in total (coin ALL)."""
    b = balances(v)
    return b.groupingSets([[F.col("venue"), F.col("ts")], [F.col("ts")]], F.col("venue"), F.col("ts")).agg(
        F.sum("stable").alias("usd")
    ).select(F.coalesce("venue", F.lit("ALL")).alias("coin"), "ts", "usd")


def deltas(v: Views):
    return op.step_deltas(supply(v), ["coin"], "usd", [1, 7, 30])


@query("stable_deltas", f"coin ts:t usd:f2 {STEPS}", "SELECT * FROM stab")
def _(spark, d):
    return deltas(Views(spark, d))


VIEWS["etf_r"] = " UNION ALL ".join(
    f"""SELECT day, {n} AS win, sum(total) OVER e{n} AS sum, avg(total) OVER e{n} AS avg, count_if(total > 0) OVER e{n} AS pos,
          count_if(total < 0) OVER e{n} AS neg, count_if(total IS NULL) OVER e{n} AS nulls,
          count_if(total IS NULL) OVER e{n} > 0 AS has_gaps
        FROM etf_total WINDOW e{n} AS (ORDER BY day ROWS {n - 1} PRECEDING) QUALIFY row_number() OVER (ORDER BY day) >= {n}"""
    for n in (5, 20)
)


@query("etf_rolling", "day:t win:i sum:f9 avg:f9 pos:i neg:i nulls:i has_gaps", "SELECT * FROM etf_r")
def _(spark, d):
    t = Views(spark, d).etf_total().withColumn("fund", F.lit("all"))
    parts = [op.etf_rolling(t, ["fund"], n).withColumn("win", F.lit(n)) for n in (5, 20)]
    return parts[0].unionByName(parts[1])


def _chg(n):
    return f"CASE WHEN lag(close, {n}) OVER w > 0 THEN (close / lag(close, {n}) OVER w - 1) * 100 END AS chg_{n}"


@query(
    "macro_changes",
    "label ts:t close:f6 chg_1:f6 chg_5:f6 chg_21:f6 vol:f9",
    f"""SELECT *, CASE WHEN rn > 20 AND count(r) OVER v >= 10 THEN stddev_samp(r) OVER v * sqrt(252) END AS vol FROM (
          SELECT *, {_chg(1)}, {_chg(5)}, {_chg(21)}, ln(close / lag(close) OVER w) AS r, row_number() OVER w AS rn
          FROM macro WINDOW w AS (PARTITION BY label ORDER BY ts))
        WINDOW v AS (PARTITION BY label ORDER BY ts ROWS 19 PRECEDING)""",
)
def _(spark, d):
    return op.macro_changes(Views(spark, d).macro(), ["label"])


VIEWS["tr_tag"] = """
  SELECT *, src IN (SELECT address FROM tracked) AS src_tracked, dst IN (SELECT address FROM tracked) AS dst_tracked,
         src IN (SELECT address FROM owners) AS src_own, dst IN (SELECT address FROM owners) AS dst_own FROM transfers"""
VIEWS["tr_ext"] = """
  SELECT * FROM tr_tag WHERE NOT ((dst_tracked AND src_own) OR (src_tracked AND dst_own)) AND value >= 1000"""


def external(v: Views):
    t = op.tag_sides(v.transfers(), {"tracked": v.tracked(), "own": v.owners()})
    return op.drop_internal(t, 1000.0)


@query("f_internal_moves", "ts:t src dst value:f2 block:i", "SELECT * FROM tr_ext")
def _(spark, d):
    return external(Views(spark, d))


@query(
    "f_mint_burn",
    "ts:t src dst value:f2 block:i",
    "SELECT * FROM transfers WHERE src NOT IN ('s1', 's2') AND dst NOT IN ('s1', 's2')",
)
def _(spark, d):
    return op.drop_mint_burn(Views(spark, d).transfers(), "s1", "s2")


@query(
    "flow_onchain_hourly",
    "ts:t inflow:f2 outflow:f2 net:f2 tx:i",
    """SELECT date_trunc('hour', ts) AS ts, sum(CASE WHEN dst_tracked THEN value ELSE 0 END) AS inflow, sum(CASE WHEN src_tracked THEN value ELSE 0 END) AS outflow,
              sum(CASE WHEN dst_tracked THEN value ELSE 0 END) - sum(CASE WHEN src_tracked THEN value ELSE 0 END) AS net, count(*) AS tx
       FROM tr_ext GROUP BY 1""",
)
def _(spark, d):
    return op.flow_onchain_hourly(external(Views(spark, d)))


VIEWS["iss"] = """
  SELECT date_trunc('day', ts) AS day, sum(CASE WHEN src = 's3' THEN value ELSE 0 END) AS issuance,
         sum(CASE WHEN dst = 's3' THEN value ELSE 0 END) AS redemption,
         sum(CASE WHEN src = 's3' THEN value ELSE 0 END) - sum(CASE WHEN dst = 's3' THEN value ELSE 0 END) AS net
  FROM transfers WHERE src NOT IN ('s1', 's2') AND dst NOT IN ('s1', 's2') GROUP BY 1"""


def issuance(v: Views):
    return op.flow_issuance_daily(op.drop_mint_burn(v.transfers(), "s1", "s2"), "s3")


@query("flow_issuance_daily", "day:t issuance:f2 redemption:f2 net:f2", "SELECT * FROM iss")
def _(spark, d):
    return issuance(Views(spark, d))


@query(
    "set_membership",
    "address in_tracked in_owners wallet_only",
    """SELECT address, address IN (SELECT address FROM tracked) AS in_tracked, true AS in_owners,
              address NOT IN (SELECT address FROM tracked) AS wallet_only FROM owners""",
)
def _(spark, d):
    v = Views(spark, d)
    tracked = v.tracked().distinct().withColumn("in_tracked", F.lit(True))
    alone = v.owners().subtract(v.tracked()).withColumn("wallet_only", F.lit(True))
    return (
        v.owners()
        .join(tracked, "address", "left")
        .join(alone, "address", "left")
        .withColumn("in_owners", F.lit(True))
        .na.fill(False, ["in_tracked", "wallet_only"])
    )
