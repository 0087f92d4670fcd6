from pyspark.sql import functions as F

from ..operators import positioning as op
from ..plans.ordered import asof_join
from ..sources.views import SPOT, Views
from .options import as_of
from .registry import query
from .views import VIEWS

VIEWS["pos"] = """
  SELECT *, CASE WHEN short AND hedge_ratio >= 0.8e0 THEN 'FULLY_HEDGED' WHEN short AND hedge_ratio >= 0.3e0 THEN 'PARTIAL_HEDGE'
                 WHEN NOT short AND total_spot_eth >= size_eth * 0.3e0 THEN 'DOUBLE_BULL' ELSE 'DIRECTIONAL_BET' END AS hedge_label,
         concat(substr(wallet, 1, 6), '…', right(wallet, 4)) AS wallet_short
  FROM (SELECT *, szi < 0 AS short, CASE WHEN szi > 0 THEN 'LONG' ELSE 'SHORT' END AS side, abs(szi) AS size_eth, abs(szi) * 1500 AS size_usd,
               (nullif(liq_px, 0) - 1500) / 1500.0e0 * 100 AS dist_liq_pct, spot_eth + mainnet_eth AS total_spot_eth,
               CASE WHEN szi < 0 THEN round(least((spot_eth + mainnet_eth) / abs(szi), 1.0e0), 3) END AS hedge_ratio
        FROM positions WHERE szi <> 0)"""


def book(v: Views):
    return op.positions_book(v.positions(), SPOT)


@query(
    "positions_book",
    "wallet wallet_short side size_eth:f6 size_usd:f4 entry_px:f2 liq_px:f2 lev:i margin_type dist_liq_pct:f6 total_spot_eth:f4 hedge_ratio:f3 hedge_label",
    "SELECT * FROM pos",
)
def _(spark, d):
    return book(Views(spark, d))


@query(
    "positions_summary",
    "long_usd:f4 short_usd:f4 net_usd:f4 longs:i shorts:i wallets:i",
    """SELECT sum(CASE WHEN short THEN 0 ELSE size_usd END) AS long_usd, sum(CASE WHEN short THEN size_usd ELSE 0 END) AS short_usd,
              sum(CASE WHEN short THEN -size_usd ELSE size_usd END) AS net_usd, count_if(NOT short) AS longs, count_if(short) AS shorts,
              count(DISTINCT wallet) AS wallets FROM pos""",
)
def _(spark, d):
    return op.positions_summary(book(Views(spark, d)))


@query(
    "positions_liq_bins",
    "price:f2 side size_usd:f4 n:i",
    """SELECT round_even(liq_px / 25.0e0, 0) * 25.0e0 AS price, side, sum(size_usd) AS size_usd, count(*) AS n FROM pos
       WHERE liq_px IS NOT NULL AND liq_px <> 0 GROUP BY ALL""",
)
def _(spark, d):
    return op.positions_liq_bins(book(Views(spark, d)))


@query(
    "positions_spot_roster",
    "wallet spot_eth:f4 spot_usd:f2",
    "SELECT wallet, spot_eth, spot_eth * 1500 AS spot_usd FROM positions WHERE spot_eth > 0",
)
def _(spark, d):
    return op.spot_roster(Views(spark, d).positions(), SPOT)


@query(
    "join_anti",
    "wallet spot_eth:f4 spot_usd:f2",
    "SELECT wallet, spot_eth, spot_eth * 1500 AS spot_usd FROM positions WHERE spot_eth > 0 AND wallet NOT IN (SELECT wallet FROM pos)",
)
def _(spark, d):
    p = Views(spark, d).positions()
    return op.spot_without_perp(p, op.positions_book(p, SPOT), SPOT)


VIEWS["oi_now"] = """
  SELECT b.*, f.rate FROM (SELECT sym, last(ts ORDER BY ts) AS ts, last(oi * close ORDER BY ts) AS oi_usd, last(close ORDER BY ts) AS spot FROM bars GROUP BY sym) b
  ASOF LEFT JOIN (SELECT * FROM funding WHERE venue = 'v0') f ON b.ts >= f.ts"""
VIEWS["liq"] = (
    """SELECT sym, leverage, side, CASE WHEN side = 'long' THEN spot * (1 - 0.8e0 / leverage) ELSE spot * (1 + 0.8e0 / leverage) END AS liq_px,
         oi_usd * share * CASE WHEN side = 'long' THEN bias ELSE 1 - bias END AS usd,
         CASE WHEN side = 'long' THEN -100 ELSE 100 END * (0.8e0 / leverage) AS pct
  FROM (SELECT *, greatest(least(0.5e0 + coalesce(rate, 0) * 5000, 0.7e0), 0.3e0) AS bias FROM oi_now), (VALUES """
    + ", ".join(f"({k}, {s}e0)" for k, s in op.LEVERAGE_TIERS.items())
    + ") AS t(leverage, share), (VALUES ('long'), ('short')) AS s(side)"
)


def liq(v: Views):
    now = v.bars().groupBy("sym").agg(F.max_by(F.struct("ts", "oi", "close"), "ts").alias("x")).select(
        "sym", "x.ts", (F.col("x.oi") * F.col("x.close")).alias("oi_usd"), F.col("x.close").alias("spot")
    )
    return op.liq_map(asof_join(now, v.funding().filter("venue = 'v0'"), [], ["rate"]), ["sym"])


@query("liq_map", "sym leverage:i side liq_px:f6 usd:f4 pct:f6", "SELECT * FROM liq")
def _(spark, d):
    return liq(Views(spark, d))


@query(
    "liq_map_summary",
    "sym side total_usd:f4 nearest_px:f6 nearest_usd:f4",
    """SELECT sym, side, sum(usd) AS total_usd, first(liq_px ORDER BY usd DESC, leverage) FILTER (abs(pct) < 5) AS nearest_px,
              max(usd) FILTER (abs(pct) < 5) AS nearest_usd FROM liq GROUP BY sym, side""",
)
def _(spark, d):
    return op.liq_map_summary(liq(Views(spark, d)), ["sym"])


@query(
    "funding_spread",
    "ts:t max_rate:f9 min_rate:f9 mean_rate:f9 spread:f9 max_venue min_venue n:i",
    """SELECT ts, max(rate) AS max_rate, min(rate) AS min_rate, avg(rate) AS mean_rate, max(rate) - min(rate) AS spread,
              first(venue ORDER BY rate DESC, venue) AS max_venue, first(venue ORDER BY rate, venue) AS min_venue, count(*) AS n
       FROM funding GROUP BY ts HAVING count(*) >= 2""",
)
def _(spark, d):
    return op.funding_spread(Views(spark, d).funding())


LEVEL = """CASE WHEN rate IS NULL THEN 'UNKNOWN' WHEN rate >= 0.0003 THEN 'HIGH' WHEN rate <= -0.0001 THEN 'NEGATIVE'
           WHEN rate <= 0.00005 THEN 'LOW' ELSE 'NORMAL' END"""


@query("funding_level", "venue ts:t rate:f9 level", f"SELECT *, {LEVEL} AS level FROM funding")
def _(spark, d):
    return Views(spark, d).funding().withColumn("level", op.funding_level("rate"))


VIEWS["fut_b"] = """
  SELECT *, CASE WHEN count(*) OVER p >= 3 THEN avg(CASE WHEN rank <= 3 THEN basis_ann END) OVER p END AS term_mid FROM (
    SELECT *, basis_pct * (365.0e0 / dte) AS basis_ann, row_number() OVER (PARTITION BY und ORDER BY dte) AS rank FROM (
      SELECT *, (epoch(expiry - TIMESTAMP '1998-01-01') + 28800) / 86400.0e0 AS dte, mark - 1500 AS basis_abs, (mark - 1500) / 1500 * 100 AS basis_pct
      FROM futures WHERE epoch(expiry - TIMESTAMP '1998-01-01') + 28800 > 0 AND mark <> 0)) WINDOW p AS (PARTITION BY und)"""
BASIS = "und expiry:t mark:f6 dte:f6 basis_abs:f6 basis_pct:f9 basis_ann:f9 oi:f2 rank:i term_mid:f9"


def basis(v: Views):
    return op.futures_basis(v.futures(), ["und"], as_of(), SPOT)


@query("futures_basis", BASIS, "SELECT * FROM fut_b")
def _(spark, d):
    return basis(Views(spark, d))


VIEWS["perps"] = """
  SELECT d AS ts, venue, perp, avg(perp) OVER (PARTITION BY d) * 1.01e0 AS spot FROM (
    SELECT date_trunc('day', ts) AS d, concat('v', user_id % 4) AS venue, avg(px) AS perp FROM ticks GROUP BY ALL)"""


def perps(v: Views):
    from pyspark.sql import Window

    day = F.date_trunc("day", "ts").alias("ts")
    p = v.ticks().groupBy(day, F.concat(F.lit("v"), F.col("user_id") % 4).alias("venue")).agg(F.avg("px").alias("perp"))
    return p.withColumn("spot", F.avg("perp").over(Window.partitionBy("ts")) * 1.01)


@query(
    "perp_basis",
    "ts:t venue perp:f6 spread:f6 basis_pct:f6 max_spread:f6 min_spread:f6 perp_avg:f6 q_pct:f6 q_ann:f6",
    """SELECT *, (mark - perp_avg) / perp_avg * 100 AS q_pct, (mark - perp_avg) / perp_avg * 100 * (365.0e0 / 30) AS q_ann FROM (
         SELECT *, perp - spot AS spread, (perp - spot) / spot * 100 AS basis_pct, max(perp - spot) OVER t AS max_spread,
                min(perp - spot) OVER t AS min_spread, avg(perp) OVER t AS perp_avg, spot * 1.02e0 AS mark
         FROM perps WINDOW t AS (PARTITION BY ts))""",
)
def _(spark, d):
    p = perps(Views(spark, d))
    front = p.groupBy("ts").agg((F.max("spot") * 1.02).alias("mark")).withColumn("dte", F.lit(30.0))
    return op.perp_basis(p, ["ts"], front)


VIEWS["v_oi"] = """
  SELECT sym, date_trunc('hour', ts) AS ts, concat('v', user_id % 4) AS venue, 1 + avg(CAST(k AS DOUBLE)) AS oi, avg(px) AS px,
         sum(px * qty) AS volume_usd, CASE WHEN user_id % 4 = 3 THEN 'usd' ELSE 'coin' END AS unit
  FROM ticks GROUP BY ALL"""


def venue_rows(v: Views):
    m = F.col("user_id") % 4
    return v.ticks().groupBy(
        "sym", F.date_trunc("hour", "ts").alias("ts"), F.concat(F.lit("v"), m).alias("venue"),
        F.when(m == 3, "usd").otherwise("coin").alias("unit"),
    ).agg((1 + F.avg("k")).alias("oi"), F.avg("px").alias("px"), F.sum(F.col("px") * F.col("qty")).alias("volume_usd"))


@query(
    "venue_totals",
    "sym ts:t total_oi:f4 total_volume:f2 top_venue top_share:f6 oi_chg_pct:f6",
    """SELECT *, top_oi * 100 / total_oi AS top_share,
              CASE WHEN row_number() OVER w >= 2 THEN (total_oi - coalesce(lag(total_oi, 48) OVER w, first(total_oi) OVER w)) /
                   coalesce(lag(total_oi, 48) OVER w, first(total_oi) OVER w) * 100 END AS oi_chg_pct
       FROM (SELECT sym, ts, sum(u) AS total_oi, sum(volume_usd) AS total_volume, max(u) AS top_oi, first(venue ORDER BY u DESC, venue) AS top_venue
             FROM (SELECT *, CASE WHEN unit = 'coin' THEN oi * px ELSE oi END AS u FROM v_oi) GROUP BY sym, ts)
       WINDOW w AS (PARTITION BY sym ORDER BY ts)""",
)
def _(spark, d):
    return op.venue_totals(venue_rows(Views(spark, d)), ["sym"])


@query(
    "ls_latest",
    "venue ts:t ratio:f6 long_pct:f6",
    "SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY venue ORDER BY ts DESC) = 1",
)
def _(spark, d):
    return op.ls_latest(Views(spark, d).ls(), ["venue"])


VIEWS["ls_al"] = """
  SELECT t.ts, l.venue, l.long_pct FROM (SELECT DISTINCT ts FROM ls WHERE venue <> 'w') t
  JOIN ls l ON l.venue <> 'w' AND abs(epoch_us(t.ts) - epoch_us(l.ts)) <= 1800000000
  QUALIFY row_number() OVER (PARTITION BY t.ts, l.venue ORDER BY abs(epoch_us(t.ts) - epoch_us(l.ts)), l.ts) = 1"""
VIEWS["ls_agg"] = "SELECT ts, avg(long_pct) AS long_pct, count(*) AS venues, avg(long_pct) / (1 - avg(long_pct)) AS ratio FROM ls_al GROUP BY ts"
RETAIL = ["b", "o", "y"]


@query("join_nearest_tolerance", "ts:t venue long_pct:f9", "SELECT * FROM ls_al")
def _(spark, d):
    return op.ls_aligned(Views(spark, d).kept("ls"), RETAIL, 1800)


@query("ls_aggregate", "ts:t long_pct:f9 venues:i ratio:f9", "SELECT * FROM ls_agg")
def _(spark, d):
    return op.ls_aggregate(Views(spark, d).kept("ls"), RETAIL, 1800)


@query(
    "ls_deltas",
    "venue ts:t h:i long_pct:f9 delta:f9",
    """SELECT a.venue, a.ts, a.h, a.long_pct, CASE WHEN a.ts > f.t0 THEN a.long_pct - coalesce(p.long_pct, f.oldest) END AS delta
       FROM (SELECT venue, ts, long_pct, h, ts - to_hours(h) AS t FROM ls, (VALUES (1), (4), (24)) AS d(h)) a
       ASOF LEFT JOIN ls p ON a.venue = p.venue AND a.t >= p.ts
       JOIN (SELECT venue, min(ts) AS t0, first(long_pct ORDER BY ts) AS oldest FROM ls GROUP BY venue) f ON f.venue = a.venue""",
)
def _(spark, d):
    return op.ls_deltas(Views(spark, d).kept("ls"), ["venue"])


VIEWS["ls_div"] = """
  SELECT a.ts, a.long_pct - w.long_pct AS value FROM ls_agg a
  JOIN (SELECT ts, long_pct FROM ls WHERE venue = 'w') w ON abs(epoch_us(a.ts) - epoch_us(w.ts)) <= 1800000000
  QUALIFY row_number() OVER (PARTITION BY a.ts ORDER BY abs(epoch_us(a.ts) - epoch_us(w.ts)), w.ts) = 1"""


@query(
    "ls_divergence",
    "now_ts:t now:f9 n:i mu:f9 sd:f9 z:f6 percentile:f6",
    """SELECT *, CASE WHEN n >= 12 AND sd > 0 THEN (now - mu) / sd END AS z, CASE WHEN n >= 12 THEN below * 100.0e0 / n END AS percentile FROM (
         SELECT now_ts, now, count(*) AS n, avg(value) AS mu, stddev_samp(value) AS sd, count_if(value <= now) AS below
         FROM ls_div, (SELECT ts AS now_ts, value AS now FROM ls_div ORDER BY ts DESC LIMIT 1) WHERE ts < now_ts GROUP BY ALL)""",
)
def _(spark, d):
    return op.ls_divergence(Views(spark, d).kept("ls"), RETAIL, "w", 1800)


VIEWS["conf"] = f"""
  SELECT l.ts, l.ratio, z.asset, z.direction, f.rate, CASE WHEN l.ratio >= 1.15 THEN 'LONG' WHEN l.ratio <= 0.87 THEN 'SHORT' ELSE 'NEUTRAL' END AS whale, {LEVEL} AS level
  FROM (SELECT ts, ratio FROM ls WHERE venue = 'w') l ASOF LEFT JOIN (SELECT ts, rate * 20 AS rate FROM funding WHERE venue = 'v0') f ON l.ts >= f.ts JOIN fl_dir z ON z.asset = concat('a', hour(l.ts) % 2)"""


@query(
    "confluence_reading",
    "ts:t asset whale direction level reading",
    """SELECT *, CASE WHEN whale = 'LONG' AND direction = 'BULLISH' AND level IN ('NORMAL', 'LOW') THEN 'CONFIRMED_BULL'
         WHEN whale = 'SHORT' AND direction = 'BEARISH' THEN 'CONFIRMED_BEAR'
         WHEN whale = 'LONG' AND direction = 'BEARISH' AND level = 'HIGH' THEN 'DIVERGENT_WHALE_WRONG_SIDE'
         WHEN whale = 'SHORT' AND direction = 'BULLISH' THEN 'DIVERGENT_WHALE_WRONG_SIDE'
         WHEN whale = 'LONG' AND level = 'HIGH' THEN 'OVERHEATED_LONG' WHEN whale = 'SHORT' AND level = 'NEGATIVE' THEN 'OVERHEATED_SHORT'
         WHEN whale = 'NEUTRAL' THEN 'WHALES_UNDECIDED' ELSE 'MIXED' END AS reading FROM conf""",
)
def _(spark, d):
    from .flows import directed

    v = Views(spark, d)
    rate = v.funding().filter("venue = 'v0'").withColumn("rate", F.col("rate") * 20)
    whales = asof_join(v.ls().filter("venue = 'w'"), rate, [], ["rate"])
    asset = F.concat(F.lit("a"), F.hour("ts") % 2)  # the fixture's readings alternate between the assets
    return (
        whales.withColumn("asset", asset)
        .join(directed(v).select("asset", "direction"), "asset")
        .select("ts", "asset", "direction", op.whale_side("ratio").alias("whale"), op.funding_level("rate").alias("level"))
        .withColumn("reading", op.confluence_reading("whale", "direction", "level"))
    )


@query(
    "cohort_exposure",
    "ts:t cohort cohort_oi:f4 long_pct:f9 long_usd:f4 short_usd:f4 net_usd:f4",
    """SELECT ts, cohort, oi_usd * share AS cohort_oi, lp AS long_pct, oi_usd * share * lp AS long_usd, oi_usd * share * (1 - lp) AS short_usd,
              oi_usd * share * (2 * lp - 1) AS net_usd
       FROM (SELECT date_trunc('hour', w.ts) AS ts, 1e6 * w.ratio AS oi_usd, c.cohort, c.share, CASE WHEN cohort = 'whale' THEN w.long_pct ELSE b.long_pct END AS lp
             FROM (SELECT * FROM ls WHERE venue = 'w') w JOIN (SELECT * FROM ls WHERE venue = 'b') b ON date_trunc('hour', w.ts) = date_trunc('hour', b.ts),
                  (VALUES ('whale', 0.75e0), ('retail', 0.25e0)) AS c(cohort, share))""",
)
def _(spark, d):
    ls = Views(spark, d).ls()
    one = lambda x, cols: ls.filter(F.col("venue") == x).select(F.date_trunc("hour", "ts").alias("ts"), *cols)
    w = one("w", [(F.col("ratio") * 1e6).alias("oi_usd"), F.col("long_pct").alias("whale_lp")])
    return op.cohort_exposure(w.join(one("b", [F.col("long_pct").alias("retail_lp")]), "ts"), ["ts"])
