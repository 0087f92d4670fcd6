from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import options as opt
from ..operators import profile as pf
from ..operators import scoring as op
from ..operators.bars import resample
from ..plans.settle import settle
from ..sources.views import SPOT, Views
from .book_profile import PERIODS as PROFILES
from .indicators import FAST_ZONE, SHORT, _pre, _rv, stoch_cols
from .options import as_of, by_strike
from .registry import query
from .research import inputs
from .views import VIEWS

WARM = 130
W_COLS = ["funding", "oi", "oi_price", "taker", "ls", "vol", "iv_rv", "ethbtc", "gamma", "vp", "stoch", "mq", "setup"]
VIEWS["weights"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{p}', '{op.FLOW_WINDOW[i]}', '{op.MQ_WINDOW[i]}', '{op.PROFILE[i]}', " + ", ".join(str(op.WEIGHTS[p][k]) for k in W_COLS) + ")"
        for i, p in enumerate(op.PERIODS)
    )
    + ") AS t(period, flow_win, mq_win, vp_period, " + ", ".join(f"w_{k}" for k in W_COLS) + ")"
)


def half(w):
    return f"CAST(ceil({w} / 2.0e0) AS INT)"


C_FUND = f"""CASE WHEN rate > 0.0003 THEN -w_funding WHEN rate > 0.0001 THEN -{half('w_funding')} WHEN rate < -0.0003 THEN w_funding
             WHEN rate < -0.0001 THEN {half('w_funding')} ELSE 0 END"""


def c_taker(up, mild, dn, dn_mild):
    return f"""CASE WHEN NOT taker > 0 THEN 0 WHEN taker > {up} THEN w_taker WHEN taker > {mild} THEN {half('w_taker')}
             WHEN taker < {dn} THEN -w_taker WHEN taker < {dn_mild} THEN -{half('w_taker')} ELSE 0 END"""


def c_stoch(prev):
    up = "fast_k > fast_d AND fast_k < 30 AND slow_k < 40" + (" AND pk <= fast_d" if prev else "")
    dn = "fast_k < fast_d AND fast_k > 70 AND slow_k > 60" + (" AND pk >= fast_d" if prev else "")
    return f"""CASE WHEN slow_k >= 80 AND slow_d >= 80 THEN -w_stoch WHEN slow_k <= 20 AND slow_d <= 20 THEN w_stoch ELSE 0 END +
             CASE WHEN {up} THEN {half('w_stoch')} WHEN {dn} THEN -{half('w_stoch')} ELSE 0 END"""


C_EB = "CASE WHEN ethbtc_chg > 2 THEN w_ethbtc WHEN ethbtc_chg < -2 THEN -w_ethbtc ELSE 0 END"
C_VP = "CASE WHEN position = 'above_va' THEN -w_vp WHEN position = 'below_va' THEN w_vp ELSE 0 END"
MOD = "greatest(least(abs(ln(CASE WHEN taker > 0 THEN taker END)) / 0.05e0, 1.5e0), 0.5e0)"
LEVEL = "CASE WHEN {0} >= 3 THEN 'bullish' WHEN {0} <= -3 THEN 'bearish' WHEN {0} = 0 THEN 'neutral' ELSE 'caution' END"


def amp(run, w, cond):
    return f"CASE WHEN {cond} AND abs({run}) >= 1 THEN sign({run}) * {w} ELSE 0 END"


VIEWS["hist"] = f"""
  SELECT *, {LEVEL.format('score_post')} AS level FROM (
    SELECT *, greatest(least(s_pre + {amp('s_pre', 'w_vol', 'vol_ratio < 0.7')} + c_ethbtc + c_vp + c_stoch, 10), -10) AS score_pre,
      greatest(least(s_post + {amp('s_post', 'w_vol', 'vol_ratio < 0.7')} + c_ethbtc + c_vp + c_stoch, 10), -10) AS score_post,
      {amp('s_post', 'w_vol', 'vol_ratio < 0.7')} AS c_vol_post
    FROM (SELECT *, c_funding + c_taker_pre AS s_pre, c_funding + c_taker_post AS s_post FROM (
      SELECT *, CASE WHEN c_taker_pre = 0 THEN 0 ELSE CAST(round_even(c_taker_pre * {MOD}, 0) AS INT) END AS c_taker_post FROM (
        SELECT *, {C_FUND} AS c_funding, {c_taker('1.15', '1.05', '1 / 1.15e0', '1 / 1.05e0')} AS c_taker_pre, {C_EB} AS c_ethbtc, {C_VP} AS c_vp,
               {c_stoch(True)} AS c_stoch
        FROM (SELECT e.*, taker_ratio AS taker, v.vol_ratio FROM ev_in e JOIN (
               SELECT sym, ts, CASE WHEN b > 0 THEN a / b END AS vol_ratio FROM (SELECT *, {_rv(2, '1')} AS a, {_rv(24, '1')} AS b FROM nrets)) v USING (sym, ts)
              WHERE rn > {WARM}), weights))))"""


def history(v: Views):
    return op.score_history(inputs(v), WARM)


@query(
    "score_history",
    "sym ts:t period score:i score_pre:i level c_funding:i c_taker_pre:i c_taker_post:i c_vol_post:i c_ethbtc:i c_vp:i c_stoch:i",
    "SELECT *, score_post AS score FROM hist",
)
def _(spark, d):
    return history(Views(spark, d))


# -- live ----------------------------------------------------------------------------------------------------------

VIEWS["st_in"] = f"""
  SELECT y.*, sp.spot_ratio, lv.flip, lv.call_wall, lv.put_wall, lv.max_pain, lv.iv_spread,
         CASE WHEN rn >= 2 THEN (oi_usd - past_oi) / past_oi * 100 END AS oi_chg, rv_4 / nullif(rv_24, 0) AS vol_ratio_live
  FROM (SELECT x.*, coalesce(lag(oi_usd, 48) OVER w, first(oi_usd) OVER w) AS past_oi, (close / lag(close, 24) OVER w - 1) * 100 AS chg_24,
          (close / nullif(btc, 0) / nullif(lag(close / nullif(btc, 0), 24) OVER w, 0) - 1) * 100 AS ethbtc_chg,
          lag(fast_k, 1) OVER w AS k1, lag(fast_k, 2) OVER w AS k2, {_rv(4)} AS rv_4, {_rv(24)} AS rv_24,
          {", ".join(f"sum(taker_buy_base) OVER {_pre(n)} / nullif(sum(greatest(volume - taker_buy_base, 0)) OVER {_pre(n)}, 0) AS f{n}_ratio" for n in (1, 4, 12, 24))}
        FROM (SELECT s.*, s.oi * s.close AS oi_usd, b.ret, b.rate * 20 AS rate, b.btc, lb.ratio AS retail, lw.ratio AS top
              FROM stoch_short s JOIN (SELECT sym, ts, ret, rate, btc FROM bbars) b USING (sym, ts)
              ASOF LEFT JOIN (SELECT * FROM ls WHERE venue = 'b') lb ON s.ts >= lb.ts ASOF LEFT JOIN (SELECT * FROM ls WHERE venue = 'w') lw ON s.ts >= lw.ts) x
        WINDOW w AS (PARTITION BY sym ORDER BY ts)) y
  LEFT JOIN spot_flow sp ON sp.sym = y.sym AND sp.ts = y.ts LEFT JOIN sym_levels lv ON lv.sym = y.sym"""
# the views it reads come before it
VIEWS["spot_flow"] = """
  SELECT sym, date_trunc('hour', ts) AS ts, sum(CASE WHEN k % 2 = 0 THEN qty ELSE 0 END) / nullif(sum(CASE WHEN k % 2 = 0 THEN 0 ELSE qty END), 0) AS spot_ratio
  FROM ticks WHERE user_id % 4 = 0 GROUP BY ALL"""
VIEWS["pains"] = """
  SELECT und, expiry, first(strike ORDER BY pay, strike) AS max_pain FROM (
    SELECT t.und, t.expiry, t.strike, sum(CASE WHEN o.is_call THEN greatest(t.strike - o.strike, 0) ELSE greatest(o.strike - t.strike, 0) END * o.oi) AS pay
    FROM (SELECT DISTINCT und, expiry, strike FROM expo) t JOIN expo o ON o.und = t.und AND o.expiry = t.expiry GROUP BY ALL)
  GROUP BY und, expiry"""
VIEWS["sym_levels"] = """
  SELECT s.sym, f.flip, wl.call_wall, wl.put_wall, pn.max_pain, i.iv - s.rv AS iv_spread
  FROM (SELECT sym, concat('u', length(sym) % 2) AS und, CASE WHEN count(ret) FILTER (nn - rn < 24) = 24
               THEN stddev_samp(ret) FILTER (nn - rn < 24) * sqrt(8760) * 100 END AS rv FROM nrets GROUP BY sym) s
  LEFT JOIN (SELECT und, first(iv ORDER BY dte) AS iv FROM term WHERE dte BETWEEN 3 AND 21 GROUP BY und) i USING (und)
  LEFT JOIN flip f USING (und)
  LEFT JOIN (SELECT und, (first(strike ORDER BY call_oi DESC, strike) FILTER (strike > 1500)) AS call_wall,
                    (first(strike ORDER BY put_oi DESC, strike) FILTER (strike < 1500)) AS put_wall
             FROM by_strike WHERE strike BETWEEN 1200 AND 1800 GROUP BY und) wl USING (und)
  LEFT JOIN (SELECT und, first(max_pain ORDER BY expiry) AS max_pain FROM pains GROUP BY und) pn USING (und)"""
VIEWS["st_in"] = VIEWS.pop("st_in")


def live(v: Views):
    ls = v.kept("ls")
    sides = [
        (v.kept("funding").filter("venue = 'v0'").withColumn("rate", F.col("rate") * 20), ["rate"]),
        (v.kept("bench"), ["btc"]),
        (ls.filter("venue = 'b'").withColumnRenamed("ratio", "retail"), ["retail"]),
        (ls.filter("venue = 'w'").withColumnRenamed("ratio", "top"), ["top"]),
    ]
    inputs = op.live_inputs(v.bars(), sides, ["sym"], SHORT["slow"], SHORT["fast"])
    und = F.concat(F.lit("u"), F.length("sym") % 2)  # every symbol has the options of one underlying
    rv = ind.realized_vol(v.bars(), ["sym"], (4, 24)).groupBy("sym", und.alias("und")).agg(F.max_by("rv_24", "ts").alias("rv"))
    per = by_strike(v)
    pain = opt.max_pain(v.options(), ["und"], as_of()).groupBy("und").agg(F.min_by("max_pain", "expiry").alias("max_pain"))
    levels = opt.gamma_flip(per, ["und"]).select("und", "flip").join(
        opt.option_walls(per, ["und"], SPOT).select("und", "call_wall", "put_wall"), "und", "left").join(pain, "und", "left")
    spread = opt.iv_rv_spread(opt.iv_term_structure(v.options(), ["und"], as_of(), SPOT), rv.filter("rv IS NOT NULL"), ["und"])
    profile = pf.volume_profile_struct(pf.period_rows(v.bars(), ["sym"], PROFILES), ["sym", "period", "size"], "size")
    return op.with_levels(
        inputs, ["sym"], spot_flow(v), rv.select("sym", "und").join(levels, "und").drop("und"),
        spread.select("sym", F.col("spread").alias("iv_spread")), profile.select("sym", "period", "position"),
    )


def spot_flow(v: Views):
    """Taker ratio of spot trades per hour; a quarter of the users trades spot."""
    buys, sells = (F.sum(F.when((F.col("k") % 2 == 0) == side, F.col("qty")).otherwise(0.0)) for side in (True, False))
    return v.ticks().filter("user_id % 4 = 0").groupBy("sym", F.date_trunc("hour", "ts").alias("ts")).agg(
        (buys / F.nullif(sells, F.lit(0.0))).alias("spot_ratio"))


SIG = """CASE WHEN rate > 0.0003 THEN 'bearish' WHEN rate > 0.0001 THEN 'caution' WHEN rate < -0.0003 THEN 'bullish' WHEN rate < -0.0001 THEN 'caution' ELSE 'neutral' END AS funding_sig,
  CASE WHEN abs(oi_chg) > 10 THEN 'caution' ELSE 'neutral' END AS oi_sig,
  CASE WHEN taker > 1.15 AND spot_ratio > 1.05 THEN 'bullish' WHEN taker < 0.85 AND spot_ratio < 0.95 THEN 'bearish'
       WHEN (taker > 1.15 AND spot_ratio < 0.95) OR (taker < 0.85 AND spot_ratio > 1.05) THEN 'caution' WHEN taker > 1.15 THEN 'bullish' WHEN taker < 0.85 THEN 'bearish' ELSE 'neutral' END AS taker_sig,
  CASE WHEN retail IS NULL OR top IS NULL THEN 'neutral' WHEN retail > 1.4 AND top < 1.15 THEN 'bearish' WHEN retail < 0.7 AND top > 0.85 THEN 'bullish'
       WHEN abs(retail - top) > 0.5 THEN 'caution' ELSE 'neutral' END AS divergence_sig"""


@query(
    "signal_panels",
    "sym ts:t funding_sig oi_sig taker_sig divergence_sig",
    f"SELECT sym, ts, {SIG} FROM (SELECT *, f4_ratio AS taker FROM st_in)",
)
def _(spark, d):
    return live(Views(spark, d)).withColumn("taker", F.col("f4_ratio")).withColumns(op.signal_panels())


def setup_sql(src, k1="k1", k2="k2"):
    r = {c: f"round({c}, 2)" for c in ("slow_k", "slow_d", "fast_k", "fast_d")}
    return f"""SELECT *, CASE WHEN setup_state IN ('ARMED', 'TRIGGERED') THEN CASE WHEN cut_direction = setup_dir THEN
          CASE cut_quality WHEN 'block' THEN 'BLOCKED' WHEN 'upgrade-mid' THEN 'A+' WHEN 'upgrade-high' THEN 'A++' ELSE 'A' END ELSE 'A' END END AS setup_quality FROM (
      SELECT *, CASE WHEN NOT known THEN NULL WHEN ob AND fob THEN 'ARMED' WHEN ob AND wob AND fk < 80 THEN 'TRIGGERED' WHEN os AND fos THEN 'ARMED'
                     WHEN os AND wos AND fk > 20 THEN 'TRIGGERED' ELSE 'INACTIVE' END AS setup_state,
             CASE WHEN NOT known THEN NULL WHEN ob AND (fob OR (wob AND fk < 80)) THEN 'short' WHEN os AND (fos OR (wos AND fk > 20)) THEN 'long' END AS setup_dir,
             CASE WHEN NOT known THEN NULL WHEN ob AND fob THEN NULL WHEN ob AND wob AND fk < 80 THEN CASE WHEN fk < 75 THEN 'strict' ELSE 'standard' END
                  WHEN os AND fos THEN NULL WHEN os AND wos AND fk > 20 THEN CASE WHEN fk > 25 THEN 'strict' ELSE 'standard' END END AS setup_trigger
      FROM (SELECT *, {r['fast_k']} AS fk, coalesce(slow_k + slow_d + fast_k + fast_d IS NOT NULL, false) AS known,
              coalesce({r['slow_k']} >= 80 AND {r['slow_d']} >= 80, false) AS ob, coalesce({r['slow_k']} <= 20 AND {r['slow_d']} <= 20, false) AS os,
              coalesce({r['fast_k']} >= 80 AND {r['fast_d']} >= 80, false) AS fob, coalesce({r['fast_k']} <= 20 AND {r['fast_d']} <= 20, false) AS fos,
              coalesce(round({k1}, 2) >= 80 AND round({k2}, 2) >= 80, false) AS wob, coalesce(round({k1}, 2) <= 20 AND round({k2}, 2) <= 20, false) AS wos FROM {src}))"""


VIEWS["st_setup"] = setup_sql(
    "(SELECT s.*, c.direction AS cut_direction, c.quality AS cut_quality, v.verdict FROM st_in s LEFT JOIN cut c ON c.sym = s.sym AND c.ts = s.ts LEFT JOIN mqv v ON v.sym = s.sym AND v.ts = s.ts)"
)


def full_inputs(v: Views):
    b = v.bars()
    mq = settle(ind.money_quality(b, ["sym"]))
    verdict = ind.money_quality_verdict(mq, ["sym"])
    cut = ind.cut_anchored_mq(b, ["sym"], FAST_ZONE)
    return op.setup_columns(op.with_quality(live(v), mq, verdict, cut, ["sym"]))


@query(
    "setup_detector",
    "sym ts:t slow_k:f6 fast_k:f6 setup_state setup_dir setup_trigger setup_quality",
    "SELECT * FROM st_setup",
)
def _(spark, d):
    return full_inputs(Views(spark, d))


@query(
    "mq_grade",
    "sym ts:t win setup tier:i verdict",
    """SELECT *, CASE WHEN tier < 0 THEN 'BLOCK' WHEN tier > 0 THEN 'UPGRADE' ELSE 'NEUTRAL' END AS verdict FROM (
         SELECT *, CASE WHEN ratio IS NULL OR NOT ((setup = 'short' AND direction = 'bullish') OR (setup = 'long' AND direction = 'bearish')) THEN 0
                        WHEN ratio < 1 THEN -1 WHEN ratio >= 5 THEN 2 WHEN ratio >= 2 THEN 1 ELSE 0 END AS tier
         FROM mq, (VALUES ('short'), ('long')) AS s(setup))""",
)
def _(spark, d):
    return op.mq_grade(ind.money_quality(Views(spark, d).bars(), ["sym"]))


_run = "c1 + c2 + c3 + c4"
VIEWS["st_score"] = f"""
  SELECT *, greatest(least(score - mod_delta, 10), -10) AS score_pre FROM (
   SELECT *, greatest(least(run11 + c11v + c12, 10), -10) AS score FROM (
    SELECT *, CASE WHEN abs(run11) <= 1 AND w_mq > 0 AND starts_with(verdict, 'ALCISTA') THEN 1 WHEN abs(run11) <= 1 AND w_mq > 0 AND starts_with(verdict, 'BAJISTA') THEN -1 ELSE 0 END AS c11v,
      CASE setup_dir WHEN 'short' THEN -1 WHEN 'long' THEN 1 ELSE 0 END * floor(w_setup * CASE setup_quality WHEN 'A++' THEN 1.5e0 WHEN 'A+' THEN 1.25e0 WHEN 'A' THEN 1 ELSE 0 END
        * CASE setup_state WHEN 'TRIGGERED' THEN 1 WHEN 'ARMED' THEN 0.6e0 WHEN 'LATE' THEN 0.2e0 ELSE 0 END + 0.5e0) AS c12
    FROM (SELECT *, run5 + c6 + c7 + c8 + c9 + c10 + c11 AS run11 FROM (
     SELECT *, {amp('run5', 'w_iv_rv', 'iv_spread > 15')} AS c6, {C_EB} AS c7,
       CASE WHEN flip IS NULL THEN 0 WHEN close > flip THEN w_gamma ELSE -w_gamma END AS c8, {C_VP} AS c9, {c_stoch(False)} AS c10,
       CASE WHEN w_mq = 0 THEN 0 ELSE CASE mq_dir WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END *
            greatest(1, floor(w_mq * CASE mq_q WHEN 'high' THEN 1 WHEN 'medium' THEN 0.5e0 ELSE 0.25e0 END + 0.5e0)) END AS c11
     FROM (SELECT *, run4 + c5 AS run5 FROM (
      SELECT *, {amp('run4', 'w_vol', 'vol_ratio_live < 0.7')} AS c5 FROM (
       SELECT *, {_run} AS run4, c3 - b3 + c4 - b4 AS mod_delta FROM (
        SELECT *, CASE WHEN b3 = 0 THEN 0 ELSE floor(b3 * {MOD} + 0.5e0) END AS c3,
          CASE WHEN b4 = 0 THEN 0 ELSE floor(b4 * greatest(least(abs(retail - top) / 0.30e0, 1.5e0), 0.5e0) + 0.5e0) END AS c4 FROM (
         SELECT *, {C_FUND} AS c1, CASE WHEN oi_chg > 8 AND rate > 0.0001 THEN -w_oi WHEN oi_chg > 8 AND rate < -0.0001 THEN w_oi ELSE 0 END
             + CASE WHEN oi_chg > 5 AND chg_24 > 2 THEN w_oi_price WHEN oi_chg > 5 AND chg_24 < -2 THEN -w_oi_price ELSE 0 END AS c2,
           {c_taker('1.15', '1.05', '0.85', '0.95')} AS b3, CASE WHEN retail > 1.4 AND top < 1.15 THEN -w_ls WHEN retail < 0.7 AND top > 0.85 THEN w_ls ELSE 0 END AS b4
         FROM (SELECT s.*, w.*, coalesce(p.position, p8.position) AS position, m.direction AS mq_dir, m.quality AS mq_q, vp.percentile AS vol_pct,
                 CASE flow_win WHEN '1h' THEN f1_ratio WHEN '4h' THEN f4_ratio WHEN '12h' THEN f12_ratio ELSE f24_ratio END AS taker
               FROM st_setup s CROSS JOIN weights w LEFT JOIN mq m ON m.sym = s.sym AND m.ts = s.ts AND m.win = w.mq_win
               LEFT JOIN vp_periods p ON p.sym = s.sym AND p.period = w.vp_period LEFT JOIN vp_periods p8 ON p8.sym = s.sym AND p8.period = '8d'
               LEFT JOIN vol_pct vp ON vp.sym = s.sym))))))))))"""
VIEWS["vol_pct"] = """
  SELECT sym, CASE WHEN count(*) >= 5 THEN count_if(rv <= rv_now) * 100.0e0 / count(*) END AS percentile
  FROM (SELECT sym, round(stddev_samp(ret) * sqrt(8760) * 100, 9) AS rv FROM nrets WHERE ret IS NOT NULL GROUP BY sym, (rn - 2) // 24 HAVING count(*) = 24)
  JOIN (SELECT sym, round(stddev_samp(ret) * sqrt(8760) * 100, 9) AS rv_now FROM nrets WHERE ret IS NOT NULL AND nn - rn < 24 GROUP BY sym HAVING count(*) = 24) USING (sym)
  GROUP BY sym, rv_now"""
VIEWS["st_score"] = VIEWS.pop("st_score")


def scored(v: Views):
    pct = ind.vol_percentile(v.bars(), ["sym"]).select("sym", F.col("percentile").alias("vol_pct"))
    return op.state_score(full_inputs(v).join(pct, "sym", "left"))


@query(
    "state_score",
    "sym ts:t period score:i score_pre:i mod_delta:i " + " ".join(f"{c}:i" for c in op.CONTRIBUTIONS),
    "SELECT * FROM st_score",
)
def _(spark, d):
    return scored(Views(spark, d))


VIEWS["st_level"] = f"""
  SELECT *, CASE WHEN clean THEN 'neutral' ELSE {LEVEL.format('score')} END AS level,
    CASE WHEN clean THEN 'CLEANSING' WHEN score >= 3 THEN CASE WHEN vol_pct <= 30 THEN 'UP_IDEAL' WHEN vol_pct >= 75 THEN 'UP_TIRED' ELSE 'UP' END
         WHEN score <= -3 THEN CASE WHEN vol_pct <= 30 THEN 'DOWN_IDEAL' WHEN vol_pct >= 75 THEN 'DOWN_TIRED' ELSE 'DOWN' END
         WHEN score = 2 THEN 'MILD_UP' WHEN score = -2 THEN 'MILD_DOWN' WHEN abs(score) = 1 THEN 'SLIGHT' ELSE 'NONE' END AS conclusion,
    concat_ws(',', CASE WHEN position = 'at_poc' AND abs(score) <= 2 THEN 'AT_POC' END, CASE WHEN close <= flip AND score <= -3 THEN 'BELOW_FLIP_DOWN' END, CASE WHEN close <= flip AND score >= 3 THEN 'BELOW_FLIP_UP' END,
      CASE WHEN close > flip AND score >= 3 THEN 'ABOVE_FLIP_UP' END, CASE WHEN close > flip AND score <= -3 THEN 'ABOVE_FLIP_DOWN' END,
      CASE WHEN (call_wall - close) / close * 100 < 3 THEN 'CALL_WALL' END, CASE WHEN abs((put_wall - close) / close * 100) < 3 THEN 'PUT_WALL' END,
      CASE WHEN abs((max_pain - close) / close * 100) < 4 THEN 'MAX_PAIN' END) AS notes,
    concat_ws(',', CASE WHEN rate > 0.0002 AND taker > 1.1 THEN 'LONGS_PAYING_TAKERS_BUYING' END, CASE WHEN rate < -0.0002 AND taker < 0.9 THEN 'SHORTS_PAYING_TAKERS_SELLING' END,
      CASE WHEN oi_chg < -10 AND vol_pct > 70 THEN 'LIQUIDATION_CASCADE' END, CASE WHEN vol_ratio_live < 0.7 AND oi_chg > 5 THEN 'COILED' END) AS warnings
  FROM (SELECT *, coalesce(oi_chg < -8 AND abs(score) <= 1, false) AS clean FROM st_score)"""


@query("state_level", "sym ts:t period score:i level conclusion notes warnings", "SELECT * FROM st_level")
def _(spark, d):
    return op.state_level(scored(Views(spark, d)))


CORR = ["c_funding", "c_taker_post", "c_vol_post", "c_ethbtc", "c_vp", "c_stoch"]


@query(
    "score_correlation",
    "period a b corr:f6",
    " UNION ALL ".join(
        f"SELECT period, '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS corr FROM hist GROUP BY period"
        for i, a in enumerate(CORR)
        for b in CORR[i + 1 :]
    ),
)
def _(spark, d):
    return op.score_correlation(settle(history(Views(spark, d)).select("period", *CORR)), CORR)


TF = {"slow": (24, 3, 5), "fast": (10, 2, 3)}
VIEWS["tf_bars"] = """
  SELECT concat(s0, '|', tf_s) AS sym, s0, CAST(tf_s AS VARCHAR) AS tf, *, row_number() OVER (PARTITION BY s0, tf_s ORDER BY ts) AS rn FROM (
    SELECT sym AS s0, tf_s, bar AS ts, last(close ORDER BY ts) AS close, max(high) AS high, min(low) AS low
    FROM (SELECT bars.*, tf_s, make_timestamp(CAST(epoch_us(ts) // (tf_s * 1000000) AS BIGINT) * (tf_s * 1000000)) AS bar
          FROM bars, (VALUES (3600::BIGINT), (7200), (14400)) AS d(tf_s)) GROUP BY ALL)"""
VIEWS["tf_stoch"] = stoch_cols("SELECT * EXCLUDE (tf_s) FROM tf_bars", TF)
VIEWS["tf_setup"] = setup_sql(
    """(SELECT t.*, lag(t.fast_k, 1) OVER w AS k1, lag(t.fast_k, 2) OVER w AS k2, c.direction AS cut_direction, c.quality AS cut_quality
        FROM tf_stoch t LEFT JOIN cut c ON c.sym = t.s0 AND c.ts = t.ts WINDOW w AS (PARTITION BY t.sym ORDER BY t.ts))"""
)
VIEWS["tf_day"] = "SELECT * FROM tf_setup QUALIFY row_number() OVER (PARTITION BY sym, date_trunc('day', ts) ORDER BY ts DESC) = 1"


@query(
    "aligned_timeframes",
    "sym day:t direction aligned n:i",
    """SELECT c.s0 AS sym, date_trunc('day', c.ts) AS day, c.setup_dir AS direction, coalesce(string_agg(o.tf, ',' ORDER BY o.tf), '') AS aligned, count(o.tf) AS n
       FROM tf_day c LEFT JOIN tf_day o ON o.s0 = c.s0 AND date_trunc('day', o.ts) = date_trunc('day', c.ts) AND o.setup_dir = c.setup_dir
            AND o.setup_state IN ('ARMED', 'TRIGGERED') AND o.setup_quality <> 'BLOCKED'
       WHERE c.tf = '3600' AND c.setup_dir IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    hourly = Views(spark, d).bars()
    b = resample(hourly, ["sym"], [3600, 7200, 14400]).withColumn("tf", F.col("tf_s").cast("string"))
    cut = ind.cut_anchored_mq(hourly, ["sym"], FAST_ZONE).select(
        "sym", "ts", F.col("direction").alias("cut_direction"), F.col("quality").alias("cut_quality"))
    s = ind.stochastics(settle(b), ["sym", "tf"], TF["slow"], TF["fast"], lags=2)
    s = op.setup_columns(s.join(cut, ["sym", "ts"], "left"))
    day = F.date_trunc("day", "ts").alias("day")
    cols = ["setup_state", "setup_dir", "setup_quality"]
    last = s.groupBy("sym", day, "tf").agg(F.max_by(F.struct(*cols), "ts").alias("x")).select("sym", "day", "tf", "x.*")
    return op.aligned_timeframes(last, ["sym", "day"], "3600")
