from pyspark.sql import functions as F

from ..functions.exprs import BETA_TERMS
from ..operators import research as op
from ..operators.regimes import split_windows
from ..plans.settle import settle
from ..sources.views import Views
from .indicators import SHORT, TRAIN_END, _pre, stoch_cols  # noqa: F401
from .registry import query
from .views import VIEWS

H = [1, 4, 12, 24]
W = "WINDOW w AS (PARTITION BY sym ORDER BY ts)"
VIEWS["hrets"] = " UNION ALL ".join(
    f"SELECT sym, ts, {h} AS h, rn - 1 - {h} AS i, ln(close / lag(close, {h}) OVER w) AS r FROM nbars {W} QUALIFY r IS NOT NULL" for h in H
)
SK = "(avg(pow(r - m, 3)) / pow(stddev_pop(r), 3))"
KU = "(avg(pow(r - m, 4)) / pow(var_pop(r), 2) - 3)"
VIEWS["mom"] = f"""
  SELECT sym, h, count(*) AS n, avg(r) * 1e4 AS mean_bp, stddev_pop(r) * 100 AS std_pct, {SK} AS skew, {KU} AS exkurt,
         min(r) * 100 AS min_pct, max(r) * 100 AS max_pct
  FROM hrets JOIN (SELECT sym, h, avg(r) AS m FROM hrets GROUP BY sym, h) USING (sym, h) GROUP BY sym, h"""
MOM = "sym h:i n:i mean_bp:f6 std_pct:f6 skew:f6 exkurt:f6 min_pct:f6 max_pct:f6"


def rets(v: Views):
    return op.horizon_returns(v.bars(), ["sym"], H)


@query("moments", MOM, "SELECT * FROM mom")
def _(spark, d):
    return op.moments(rets(Views(spark, d)), ["sym"])


@query(
    "jarque_bera",
    "sym h:i n:i jb:f6 p:f9 rejected",
    "SELECT *, exp(-jb / 2) AS p, exp(-jb / 2) < 0.01 AS rejected FROM (SELECT *, n / 6.0e0 * (skew * skew + exkurt * exkurt / 4) AS jb FROM mom)",
)
def _(spark, d):
    return op.jarque_bera(op.moments(rets(Views(spark, d)), ["sym"]))


@query(
    "tail_freq",
    "sym h:i n:i obs_3:f9 obs_4:f9 obs_5:f9 left_3:f9 right_3:f9 ratio_3:f6 ratio_4:f4 ratio_5:f2 left_right:f6",
    """SELECT *, obs_3 / 0.0026997960632601866e0 AS ratio_3, obs_4 / 6.334248366623973e-05 AS ratio_4, obs_5 / 5.733031437583869e-07 AS ratio_5,
              left_3 / nullif(right_3, 0) AS left_right FROM (
         SELECT sym, h, count(*) AS n, count_if(abs(z) > 3) / count(*) AS obs_3, count_if(abs(z) > 4) / count(*) AS obs_4,
                count_if(abs(z) > 5) / count(*) AS obs_5, count_if(z < -3) / count(*) AS left_3, count_if(z > 3) / count(*) AS right_3
         FROM (SELECT sym, h, (r - avg(r) OVER p) / stddev_pop(r) OVER p AS z FROM hrets WINDOW p AS (PARTITION BY sym, h)) GROUP BY sym, h)""",
)
def _(spark, d):
    return op.tail_freq(rets(Views(spark, d)), ["sym"])


LAGS = [1, 2, 4, 8, 24, 48]


@query(
    "autocorr",
    "sym kind lag:i acf:f6 acf_abs:f6 n:i reading",
    " UNION ALL ".join(
        f"""SELECT sym, 'lag' AS kind, {k} AS lag, corr(ret, past) AS acf, corr(abs(ret), abs(past)) AS acf_abs, count(*) AS n, CAST(NULL AS VARCHAR) AS reading
            FROM (SELECT sym, ret, lag(ret, {k}) OVER w AS past FROM nrets {W}) WHERE ret IS NOT NULL AND past IS NOT NULL GROUP BY sym"""
        for k in LAGS
    )
    + " UNION ALL SELECT sym, 'block' AS kind, h AS lag, a AS acf, CAST(NULL AS DOUBLE) AS acf_abs, n, CASE WHEN a < -0.03 THEN 'mean-reversion' WHEN a > 0.03 THEN 'momentum' WHEN a IS NOT NULL THEN 'random walk' END AS reading FROM ("
    + """SELECT sym, h, corr(r, past) AS a, count(*) AS n FROM (
           SELECT sym, h, r, lag(r) OVER (PARTITION BY sym, h ORDER BY ts) AS past FROM hrets WHERE i % h = 0) GROUP BY sym, h)""",
)
def _(spark, d):
    b = Views(spark, d).bars()
    one = op.autocorr(b, ["sym"], LAGS).withColumns({"kind": F.lit("lag"), "reading": F.lit(None).cast("string")})
    two = op.autocorr_blocks(b, ["sym"], H).select(
        "sym", F.col("h").alias("lag"), F.col("acf1").alias("acf"), F.lit(None).cast("double").alias("acf_abs"), "n",
        F.lit("block").alias("kind"), "reading",
    )
    return one.unionByName(two)


@query(
    "regime_moments",
    "sym state:i n:i mean_bp:f6 std_pct:f6 skew:f6 exkurt:f6 p_up:f6",
    f"""SELECT sym, state, count(*) AS n, avg(r) * 1e4 AS mean_bp, stddev_pop(r) * 100 AS std_pct, {SK} AS skew, {KU} AS exkurt,
              count_if(r > 0) * 100.0e0 / count(*) AS p_up
       FROM (SELECT *, avg(r) OVER (PARTITION BY sym, state) AS m FROM (SELECT sym, state, lead(ret) OVER w AS r FROM states {W}) WHERE r IS NOT NULL)
       GROUP BY sym, state HAVING count(*) >= 10""",
)
def _(spark, d):
    return op.regime_moments(Views(spark, d).states(), ["sym"])


VIEWS["cal"] = (
    "SELECT sym, h, s AS state, count(*) AS n, "
    + ", ".join(f"quantile_cont(a, {p}e0) AS {n}" for n, p in op.CUTS.items())
    + """, stddev_pop(a) AS std_abs_ret FROM (
      SELECT sym, h, abs(r) AS a, unnest([CAST(state AS VARCHAR), 'ALL']) AS s FROM hrets JOIN (SELECT sym, ts, state FROM states) USING (sym, ts))
      GROUP BY sym, h, s HAVING count(*) >= 50"""
)
CAL = "sym h:i state n:i p50:f9 p75:f9 p90:f9 p95:f9 p99:f9 std_abs_ret:f9"


def cal(v: Views):
    return op.magnitude_calibration(rets(v), v.states(), ["sym"])


@query("magnitude_calibration", CAL, "SELECT * FROM cal")
def _(spark, d):
    return cal(Views(spark, d))


@query(
    "gaussian_mispricing",
    "sym h:i state n:i p99_sigma:f6 gap:f6 too_often",
    "SELECT *, p99_sigma - 2.58 AS gap, p99_sigma > 2.8 AS too_often FROM (SELECT *, p99 / std_abs_ret AS p99_sigma FROM cal)",
)
def _(spark, d):
    return op.gaussian_mispricing(cal(Views(spark, d)))


VIEWS["moves"] = """
  SELECT m.sym, m.ts, m.h, m.a, m.state, CASE WHEN o.sym IS NOT NULL THEN m.state ELSE 'ALL' END AS regime_used,
         coalesce(o.p50, e.p50) AS p50, coalesce(o.p75, e.p75) AS p75, coalesce(o.p90, e.p90) AS p90, coalesce(o.p95, e.p95) AS p95,
         coalesce(o.p99, e.p99) AS p99
  FROM (SELECT sym, ts, h, abs(r) AS a, CASE WHEN i % 7 = 0 THEN 'OTHER' ELSE CAST(state AS VARCHAR) END AS state
        FROM hrets LEFT JOIN (SELECT sym, ts, state FROM states) USING (sym, ts)) m
  LEFT JOIN cal o ON o.sym = m.sym AND o.h = m.h AND o.state = m.state
  JOIN cal e ON e.sym = m.sym AND e.h = m.h AND e.state = 'ALL'"""


def moves(v: Views):
    r = rets(v).join(v.states().select("sym", "ts", "state"), ["sym", "ts"], "left")
    state = F.when(F.col("i") % 7 == 0, "OTHER").otherwise(F.col("state").cast("string"))
    return op.with_cuts(r.withColumns({"a": F.abs("r"), "state": state}), settle(cal(v)), ["sym"])


@query("join_broadcast_dim", "sym ts:t h:i a:f9 regime_used p50:f9 p99:f9", "SELECT * FROM moves")
def _(spark, d):
    return moves(Views(spark, d)).filter("cuts IS NOT NULL").select("*", "cuts.*")


@query(
    "magnitude_label",
    "sym ts:t h:i a:f9 regime_used label percentile:f6",
    """SELECT *, CASE WHEN a >= p99 THEN 'EXTREME' WHEN a >= p90 THEN 'ELEVATED' WHEN a >= p50 THEN 'NORMAL' ELSE 'NOISE' END AS label,
         CASE WHEN a <= p50 THEN 50 * coalesce(a / nullif(p50, 0), 0) WHEN a <= p75 THEN 50 + 25 * coalesce((a - p50) / nullif(p75 - p50, 0), 0)
              WHEN a <= p90 THEN 75 + 15 * coalesce((a - p75) / nullif(p90 - p75, 0), 0) WHEN a <= p95 THEN 90 + 5 * coalesce((a - p90) / nullif(p95 - p90, 0), 0)
              WHEN a <= p99 THEN 95 + 4 * coalesce((a - p95) / nullif(p99 - p95, 0), 0) WHEN a <= p99 * 2 THEN 99 + (a - p99) / nullif(p99, 0)
              ELSE 100 END AS percentile FROM moves""",
)
def _(spark, d):
    return op.magnitude_label(moves(Views(spark, d)))


HOURS = [1, 4, 12, 24]
VIEWS["scored"] = """
  SELECT l.sym, l.seq, l.ts, l.score, b0.close AS c0, """ + ", ".join(
    f"CASE WHEN b0.close > 0 THEN b{h}.close / b0.close - 1 END AS ret_{h}h" for h in HOURS
) + """, CASE WHEN bp.close > 0 THEN b0.close / bp.close - 1 END AS prev_1h
  FROM state_log l ASOF LEFT JOIN bars b0 ON l.sym = b0.sym AND l.ts >= b0.ts
  ASOF LEFT JOIN bars bp ON l.sym = bp.sym AND l.ts - INTERVAL 1 HOUR >= bp.ts """ + " ".join(
    f"ASOF LEFT JOIN bars b{h} ON l.sym = b{h}.sym AND l.ts + INTERVAL {h} HOUR >= b{h}.ts" for h in HOURS
)
VIEWS["slong"] = " UNION ALL ".join(
    f"SELECT sym, seq, ts, score, prev_1h, {h} AS h, ret_{h}h AS ret FROM scored WHERE ret_{h}h IS NOT NULL" for h in HOURS
)


def scored(v: Views):
    return op.attach_returns(v.state_log(), v.bars(), ["sym"], [-1, *HOURS])


def slong(v: Views):
    return op.by_horizon(scored(v), ["sym", "score"], HOURS)


@query("join_asof_offset", "sym seq:i ts:t score:i ret_1h:f9 ret_4h:f9 ret_12h:f9 ret_24h:f9 prev_1h:f9", "SELECT * FROM scored")
def _(spark, d):
    return scored(Views(spark, d))


# two-sided p-value of column t with df degrees of freedom: the same continued fraction, folded from its last term
_STEPS = f"list_transform(range({BETA_TERMS + 1}, 0, -1), lambda k: k::DOUBLE)"  # the first is only where the fold starts


def _fraction_sql(x, a, b):
    return f"""list_reduce({_STEPS}, lambda u, k: 1 + CASE WHEN k % 2 = 0
      THEN floor(k / 2) * ({b} - floor(k / 2)) * {x} / (({a} + 2 * floor(k / 2) - 1) * ({a} + 2 * floor(k / 2)))
      ELSE -({a} + floor(k / 2)) * ({a} + {b} + floor(k / 2)) * {x} / (({a} + 2 * floor(k / 2)) * ({a} + 2 * floor(k / 2) + 1)) END / u, 1.0::DOUBLE)"""


def _p_sql(src):
    front = "exp(a * ln(x) + 0.5 * ln(1 - x) + lgamma(a + 0.5) - lgamma(a) - lgamma(0.5))"
    return f"""SELECT * EXCLUDE (a, x), CASE WHEN abs(ic) >= 1 THEN 0.0e0 WHEN x <= 0 THEN 0.0e0 WHEN x >= 1 THEN 1.0e0
      WHEN x < (a + 1) / (a + 2.5) THEN {front} / (a * {_fraction_sql("x", "a", "0.5e0")})
      ELSE 1 - {front} / (0.5 * {_fraction_sql("(1 - x)", "0.5e0", "a")}) END AS p
      FROM (SELECT *, (n - 2) / 2.0e0 AS a, (n - 2) / (n - 2 + t_stat * t_stat) AS x FROM ({src}))"""


def _ic_sql(src, by, x, y, n):
    return _p_sql(_t_sql(src, by, x, y, n))


def _t_sql(src, by, x, y, n):
    return f"""SELECT {by}, n, CASE WHEN n >= {n} THEN ic END AS ic, CASE WHEN n >= {n} AND abs(ic) < 1 THEN ic * sqrt((n - 2) / (1 - ic * ic)) END AS t_stat FROM (
      SELECT {by}, count(*) AS n, corr(rx, ry) AS ic FROM (
        SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0e0 AS rx,
               rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0e0 AS ry
        FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by})"""


VIEWS["ic"] = _ic_sql("slong", "sym, h", "score", "ret", 10)


@query("rank_ic", "sym h:i n:i ic:f6 t_stat:f6 p:f9 inverted:f6", "SELECT *, -ic AS inverted FROM ic")
def _(spark, d):
    return op.rank_ic(slong(Views(spark, d)), ["sym"]).withColumn("inverted", -F.col("ic"))


_bin = "CASE " + " ".join(f"WHEN abs(score) BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in op.SCORE_BINS) + " END"
VIEWS["acc"] = f"""
  SELECT sym, h, bin, count(*) AS n, avg(CASE WHEN sign(score) = sign(ret) THEN 1.0e0 ELSE 0 END) AS accuracy
  FROM (SELECT *, unnest([{_bin}, 'ALL']) AS bin FROM slong WHERE score <> 0 AND ret <> 0) WHERE bin IS NOT NULL GROUP BY sym, h, bin"""


@query(
    "sign_accuracy",
    "sym h:i bin n:i accuracy:f9 rising",
    """SELECT a.*, r.rising FROM acc a LEFT JOIN (
         SELECT sym, h, CASE WHEN count(*) >= 2 THEN NOT coalesce(bool_or(fall), false) END AS rising
         FROM (SELECT *, accuracy < lag(accuracy) OVER (PARTITION BY sym, h ORDER BY bin) AS fall FROM acc WHERE bin <> 'ALL' AND n >= 5) GROUP BY sym, h) r
       USING (sym, h)""",
)
def _(spark, d):
    return op.sign_accuracy(slong(Views(spark, d)), ["sym"])


@query(
    "baseline_lift",
    "sym h:i n:i score_acc:f9 base_acc:f9 lift_pp:f6",
    """SELECT *, (score_acc - base_acc) * 100 AS lift_pp FROM (
         SELECT sym, h, count(*) AS n, avg(CASE WHEN sign(score) = sign(ret) THEN 1.0e0 ELSE 0 END) AS score_acc,
                avg(CASE WHEN sign(prev_1h) = sign(ret) THEN 1.0e0 ELSE 0 END) AS base_acc
         FROM slong WHERE score <> 0 AND ret <> 0 AND prev_1h <> 0 GROUP BY sym, h)""",
)
def _(spark, d):
    return op.baseline_lift(scored(Views(spark, d)), ["sym"], HOURS)


VIEWS["day_close"] = "SELECT label, ts AS day, " + ", ".join(
    f"lead(close, {n}) OVER (PARTITION BY label ORDER BY ts) / close - 1 AS ret_{n}" for n in (1, 3, 7, 14)
) + " FROM macro"
VIEWS["iss_roll"] = """
  SELECT day, 'daily' AS kind, net AS x FROM iss UNION ALL
  SELECT day, 'rolling' AS kind, sum(net) OVER (ORDER BY day ROWS 6 PRECEDING) AS x FROM iss QUALIFY row_number() OVER (ORDER BY day) >= 7"""
VIEWS["lead_rows"] = " UNION ALL ".join(
    f"SELECT label, kind, {n} AS h, x, ret_{n} AS ret FROM iss_roll JOIN day_close USING (day)" for n in (1, 3, 7, 14)
)


@query("issuance_lead_ic", "label kind h:i n:i ic:f6 t_stat:f6 p:f9", _ic_sql("lead_rows", "label, kind, h", "x", "ret", 20))
def _(spark, d):
    from .flows import issuance

    v = Views(spark, d)
    close = v.kept("macro").select("label", F.col("ts").alias("day"), "close")
    return op.issuance_lead_ic(issuance(v), close, ["label"], [1, 3, 7, 14])


# -- events --------------------------------------------------------------------------------------------------------

VIEWS["ev_in"] = f"""
  SELECT *, CASE WHEN vwap_std IS NULL OR vwap IS NULL OR vwap_std = 0 THEN 'unknown' WHEN close > vwap + vwap_std THEN 'above_va'
                 WHEN close < vwap - vwap_std THEN 'below_va' ELSE 'in_va' END AS position
  FROM (SELECT s.*, b.rate * 20 AS rate, s.taker_buy_base / nullif(s.volume - s.taker_buy_base, 0) AS taker_ratio, (2 * s.taker_buy_base - s.volume) / s.volume AS imbalance,
          CASE WHEN s.rn >= 24 THEN sum((high + low + s.close) / 3 * s.volume) OVER p / sum(s.volume) OVER p END AS vwap,
          CASE WHEN s.rn >= 24 THEN stddev_samp(s.close) OVER p END AS vwap_std,
          (s.close / nullif(b.btc, 0) / nullif(lag(s.close / nullif(b.btc, 0), 24) OVER w, 0) - 1) * 100 AS ethbtc_chg,
          CASE WHEN s.rn >= 90 THEN s.volume / nullif(median(s.volume) OVER m, 0) END AS vol_rel, lag(fast_k) OVER w AS pk, lag(fast_d) OVER w AS pd,
          {", ".join(f"lead(s.close, {h}) OVER w / s.close - 1 AS fwd_{h}" for h in (4, 12, 24))}
        FROM stoch_short s JOIN (SELECT sym, ts, rate, btc FROM bbars) b USING (sym, ts)
        WINDOW w AS (PARTITION BY s.sym ORDER BY s.ts), p AS (PARTITION BY s.sym ORDER BY s.ts ROWS 23 PRECEDING),
               m AS (PARTITION BY s.sym ORDER BY s.ts ROWS 89 PRECEDING))"""
SIGNS = """CASE WHEN rate > 0.0001 THEN -1 WHEN rate < -0.0001 THEN 1 ELSE 0 END AS s_funding,
  CASE WHEN taker_ratio > 1.05 THEN 1 WHEN taker_ratio > 0 AND taker_ratio < 1 / 1.05e0 THEN -1 ELSE 0 END AS s_taker,
  CASE WHEN ethbtc_chg > 2 THEN 1 WHEN ethbtc_chg < -2 THEN -1 ELSE 0 END AS s_ethbtc,
  CASE WHEN position = 'above_va' THEN -1 WHEN position = 'below_va' THEN 1 ELSE 0 END AS s_vp"""
VIEWS["ev"] = f"""
  SELECT *, (s_funding = dir)::INT + (s_taker = dir)::INT + (s_ethbtc = dir)::INT + (s_vp = dir)::INT AS n_confirm,
         fwd_4 * dir AS r_4, fwd_12 * dir AS r_12, fwd_24 * dir AS r_24
  FROM (SELECT e.*, d.side, d.pos, CASE WHEN d.side = 'long' THEN 1 ELSE -1 END AS dir, {SIGNS} FROM ev_in e JOIN (SELECT sym, ts, side, pos FROM dedup) d USING (sym, ts))"""
EH = [4, 12, 24]


def inputs(v: Views):
    rate = v.kept("funding").filter("venue = 'v0'").withColumn("rate", F.col("rate") * 20)
    return op.factor_inputs(v.bars(), rate, v.kept("bench"), ["sym"], SHORT["slow"], SHORT["fast"], EH)


def events(v: Views):
    return settle(op.trigger_events(inputs(v), ["sym"], 6, EH))


@query(
    "confluence_sign",
    "sym ts:t s_funding:i s_taker:i s_ethbtc:i s_vp:i",
    f"SELECT sym, ts, {SIGNS} FROM ev_in",
)
def _(spark, d):
    return inputs(Views(spark, d)).withColumns(op.factor_signs())


@query(
    "event_baseline",
    "h:i n:i mean:f9 median:f9 hit:f9 long_hit:f9 short_hit:f9",
    " UNION ALL ".join(
        f"""SELECT {h} AS h, count(*) AS n, avg(r_{h}) AS mean, median(r_{h}) AS median, avg((r_{h} > 0)::INT) AS hit,
              avg((r_{h} > 0)::INT) FILTER (side = 'long') AS long_hit, avg((r_{h} > 0)::INT) FILTER (side = 'short') AS short_hit
            FROM ev WHERE r_{h} IS NOT NULL HAVING count(*) > 0"""
        for h in EH
    ),
)
def _(spark, d):
    return op.event_baseline(events(Views(spark, d)), EH)


@query(
    "event_attribution",
    "factor confirm_n:i confirm_ret:f6 contra_n:i contra_ret:f6 edge_pp:f6",
    "SELECT *, confirm_ret - contra_ret AS edge_pp FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS factor, count_if(s_{f} = dir) AS confirm_n, avg(CASE WHEN s_{f} = dir THEN r_12 END) * 100 AS confirm_ret,
              count_if(s_{f} = -dir) AS contra_n, avg(CASE WHEN s_{f} = -dir THEN r_12 END) * 100 AS contra_ret
            FROM ev WHERE r_12 IS NOT NULL HAVING count(*) > 0"""
        for f in op.FACTORS
    )
    + ")",
)
def _(spark, d):
    return op.event_attribution(events(Views(spark, d)), 12)


@query(
    "event_confluence",
    "n_confirm:i n:i mean_ret:f6 hit_pct:f6",
    "SELECT n_confirm, count(*) AS n, avg(r_12) * 100 AS mean_ret, avg((r_12 > 0)::INT) * 100 AS hit_pct FROM ev WHERE r_12 IS NOT NULL GROUP BY n_confirm",
)
def _(spark, d):
    return op.event_confluence(events(Views(spark, d)), 12)


@query(
    "event_volume_buckets",
    "view bucket n:i mean_ret:f6 hit_pct:f6",
    """SELECT view, bucket, count(*) AS n, avg(r) * 100 AS mean_ret, avg((r > 0)::INT) * 100 AS hit_pct FROM (
         SELECT 'volume' AS view, r_12 AS r, CASE WHEN vol_rel >= 3 THEN 'climax >3' WHEN vol_rel >= 1.5 THEN 'high 1.5-3'
                WHEN vol_rel >= 0.8 THEN 'normal 0.8-1.5' WHEN vol_rel >= 0 THEN 'low <0.8' END AS bucket FROM ev
         UNION ALL SELECT 'imbalance' AS view, r_12 AS r, CASE WHEN -imbalance * dir >= 0.06 THEN 'extreme >0.06' WHEN -imbalance * dir >= 0.03 THEN 'strong 0.03-0.06'
                WHEN -imbalance * dir >= 0 THEN 'mild 0-0.03' WHEN imbalance IS NOT NULL THEN 'aligned <0' END AS bucket FROM ev)
       WHERE r IS NOT NULL AND bucket IS NOT NULL GROUP BY view, bucket""",
)
def _(spark, d):
    return op.event_volume_buckets(events(Views(spark, d)), 12)


@query(
    "p_split_windows",
    "sym ts:t close:f6 part",
    """SELECT sym, ts, close, CASE WHEN ts <= TIMESTAMP '2024-01-16' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-23' THEN 'val' ELSE 'test' END AS part FROM bars""",
)
def _(spark, d):
    return split_windows(Views(spark, d).bars(), "2024-01-16", "2024-01-23")
