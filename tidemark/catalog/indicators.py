from ..operators import indicators as op
from ..plans.ordered import top_k  # noqa: F401
from ..sources.views import Views
from .registry import query
from .views import VIEWS

W = "WINDOW w AS (PARTITION BY sym ORDER BY ts)"
# Thirty days of hourly data: shorter stochastics keep the event queries busy.
SHORT = {"slow": (100, 10, 10), "fast": (24, 3, 5)}
FAST_ZONE = (48, 6, 3)


def _pre(n: int) -> str:
    return f"(PARTITION BY sym ORDER BY ts ROWS {n - 1} PRECEDING)"


def stoch_cols(src: str, params: dict) -> str:
    """SQL for both stochastics over ``src`` (which has ``rn``)."""
    sql = src
    for p, (k, ks, ds) in params.items():
        sql = f"""SELECT *, CASE WHEN rn >= {k} THEN CASE WHEN max(high) OVER {_pre(k)} = min(low) OVER {_pre(k)} THEN 50.0e0
            ELSE (close - min(low) OVER {_pre(k)}) / (max(high) OVER {_pre(k)} - min(low) OVER {_pre(k)}) * 100 END END AS {p}_raw
            FROM ({sql})"""
        sql = f"SELECT *, CASE WHEN rn >= {k + ks - 1} THEN avg({p}_raw) OVER {_pre(ks)} END AS {p}_k FROM ({sql})"
        sql = f"SELECT *, CASE WHEN rn >= {k + ks + ds - 2} THEN avg({p}_k) OVER {_pre(ds)} END AS {p}_d FROM ({sql})"
    return sql


VIEWS["nbars"] = f"SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sym) AS nn FROM bars {W}"
VIEWS["stoch_live"] = stoch_cols("SELECT * FROM nbars", op.LIVE)
VIEWS["stoch_short"] = stoch_cols("SELECT * FROM nbars", SHORT)
VIEWS["stoch_zone"] = stoch_cols("SELECT * FROM nbars", {"fast": FAST_ZONE})
VIEWS["nrets"] = f"""SELECT *, CASE WHEN lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret FROM nbars {W}"""


@query(
    "stochastic",
    "sym ts:t close:f6 slow_k:f6 slow_d:f6 fast_k:f6 fast_d:f6",
    "SELECT * FROM stoch_live",
)
def _(spark, d):
    return op.stochastics(Views(spark, d).bars(), ["sym"], op.LIVE["slow"], op.LIVE["fast"])


def _rv(n, f="sqrt(8760) * 100"):
    return f"CASE WHEN rn >= {n + 1} THEN stddev_samp(ret) OVER {_pre(n)} * {f} END"


@query(
    "realized_vol",
    "sym ts:t close:f6 rv_4:f6 rv_24:f6 rv_168:f6 rv_ratio:f6",
    f"""SELECT *, rv_4 / nullif(rv_24, 0) AS rv_ratio FROM (
        SELECT *, {_rv(4)} AS rv_4, {_rv(24)} AS rv_24, {_rv(168)} AS rv_168 FROM nrets)""",
)
def _(spark, d):
    return op.realized_vol(Views(spark, d).bars(), ["sym"])


@query(
    "vol_percentile",
    "sym rv_now:f6 days:i percentile:f6 label",
    """SELECT *, CASE WHEN percentile <= 20 THEN 'MUY BAJA' WHEN percentile <= 40 THEN 'BAJA' WHEN percentile <= 60 THEN 'MEDIA'
              WHEN percentile <= 80 THEN 'ALTA' WHEN percentile IS NOT NULL THEN 'MUY ALTA' END AS label FROM (
         SELECT sym, rv_now, count(*) AS days,
                CASE WHEN count(*) >= 5 THEN count_if(rv <= rv_now) * 100.0e0 / count(*) END AS percentile
         FROM (SELECT sym, round(stddev_samp(ret) * sqrt(8760) * 100, 9) AS rv FROM nrets WHERE ret IS NOT NULL
               GROUP BY sym, (rn - 2) // 24 HAVING count(*) = 24)
         JOIN (SELECT sym, round(stddev_samp(ret) * sqrt(8760) * 100, 9) AS rv_now FROM nrets
               WHERE ret IS NOT NULL AND nn - rn < 24 GROUP BY sym HAVING count(*) = 24) USING (sym)
         GROUP BY sym, rv_now)""",
)
def _(spark, d):
    return op.vol_percentile(Views(spark, d).bars(), ["sym"])


@query(
    "rv_history",
    "sym ts:t rv:f6",
    f"SELECT * FROM (SELECT *, {_rv(24)} AS rv FROM nrets) WHERE nn - rn < 60 AND rv IS NOT NULL",
)
def _(spark, d):
    return op.rv_history(Views(spark, d).bars(), ["sym"])


PARK = f"CASE WHEN rn >= 24 THEN sqrt(sum(pow(ln(high / low), 2)) OVER {_pre(24)} / (4 * 24 * ln(2))) END"


@query("parkinson_vol", "sym ts:t parkinson:f9", f"SELECT sym, ts, {PARK} AS parkinson FROM nbars")
def _(spark, d):
    return op.parkinson_vol(Views(spark, d).bars(), ["sym"])


def _z(col, n):
    f = f"(PARTITION BY sym ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""CASE WHEN count({col}) OVER {f} = {n} THEN
               ({col} - avg({col}) OVER {f}) / nullif(stddev_samp({col}) OVER {f}, 0) END"""


@query("causal_zscore", "sym ts:t close:f6 z:f6", f"SELECT sym, ts, close, {_z('close', 100)} AS z FROM bars")
def _(spark, d):
    return op.causal_zscore(Views(spark, d).bars(), ["sym"], "close", 100)


SKEW = f"CASE WHEN count(ret) OVER {_pre(20)} = 20 THEN skewness(ret) OVER {_pre(20)} END"


@query("rolling_skew", "sym ts:t skew:f6", f"SELECT sym, ts, {SKEW} AS skew FROM nrets")
def _(spark, d):
    return op.rolling_skew(Views(spark, d).bars(), ["sym"])


VIEWS["bbars"] = f"""
  SELECT *, ln(btc / lag(btc) OVER w) AS bret FROM (
    SELECT n.*, f.rate, b.btc, b.vix FROM nrets n ASOF LEFT JOIN (SELECT * FROM funding WHERE venue = 'v0') f ON n.ts >= f.ts
    ASOF LEFT JOIN bench b ON n.ts >= b.ts) {W}"""


def _fs(col, n):
    return f"CASE WHEN count({col}) OVER {_pre(n)} = {n} THEN sum({col}) OVER {_pre(n)} END"


@query(
    "relative_return",
    "sym ts:t rel:f9",
    f"SELECT sym, ts, {_fs('ret', 20)} - {_fs('bret', 20)} AS rel FROM bbars",
)
def _(spark, d):
    v = Views(spark, d)
    return op.relative_return(v.bars(), v.bench(), ["sym"])


VIEWS["features"] = f"""
  SELECT * FROM (SELECT sym, ts, ret AS log_return, {_rv(24, '1')} AS realized_vol, {PARK} AS parkinson_vol,
           (2 * taker_buy_base - volume) / volume AS taker_imbalance, {SKEW} AS return_skew,
           {_z('rate', 100)} AS funding_z, {_fs('ret', 20)} - {_fs('bret', 20)} AS rel_return, {_z('vix', 100)} AS vix_z
    FROM bbars)
  WHERE log_return + realized_vol + parkinson_vol + taker_imbalance + return_skew + funding_z + rel_return + vix_z IS NOT NULL"""

FEATURE_COLS = "sym ts:t " + " ".join(f"{f}:f6" for f in op.FEATURES)


def features(v: Views):
    return op.regime_features(v.bars(), v.kept("funding").filter("venue = 'v0'"), v.kept("bench"), ["sym"], n_z=100)


@query("regime_features", FEATURE_COLS, "SELECT * FROM features")
def _(spark, d):
    return features(Views(spark, d))


TRAIN_END = "2024-01-21"


@query(
    "standardize",
    FEATURE_COLS,
    "SELECT f.sym, f.ts, "
    + ", ".join(
        f"({c} - (avg({c}) FILTER (f.ts < TIMESTAMP '{TRAIN_END}') OVER s)) / "
        f"(CASE WHEN (stddev_samp({c}) FILTER (f.ts < TIMESTAMP '{TRAIN_END}') OVER s) = 0 THEN 1 "
        f"ELSE (stddev_samp({c}) FILTER (f.ts < TIMESTAMP '{TRAIN_END}') OVER s) END) AS {c}"
        for c in op.FEATURES
    )
    + f" FROM features f WHERE f.sym IN (SELECT sym FROM features WHERE ts < TIMESTAMP '{TRAIN_END}')"
    + " WINDOW s AS (PARTITION BY sym)",
)
def _(spark, d):
    f = features(Views(spark, d))
    return op.standardize(f, f.filter(f"ts < TIMESTAMP '{TRAIN_END}'"), ["sym"], op.FEATURES)


VWAP = f"""SELECT *, CASE WHEN vwap_std IS NULL OR vwap IS NULL OR vwap_std = 0 THEN 'unknown' WHEN close > vwap + vwap_std THEN 'above_va'
    WHEN close < vwap - vwap_std THEN 'below_va' ELSE 'in_va' END AS position FROM (
      SELECT *, CASE WHEN rn >= 24 THEN sum((high + low + close) / 3 * volume) OVER {_pre(24)} / sum(volume) OVER {_pre(24)} END AS vwap,
             CASE WHEN rn >= 24 THEN stddev_samp(close) OVER {_pre(24)} END AS vwap_std FROM nbars)"""


@query("vwap_band", "sym ts:t close:f6 vwap:f6 vwap_std:f6 position", VWAP)
def _(spark, d):
    return op.vwap_band(Views(spark, d).bars(), ["sym"])


@query(
    "pct_change",
    "sym ts:t rel:f6 chg_pct:f6",
    f"SELECT *, (rel / nullif(lag(rel, 24) OVER w, 0) - 1) * 100 AS chg_pct FROM (SELECT *, close / nullif(btc, 0) AS rel FROM bbars) {W}",
)
def _(spark, d):
    v = Views(spark, d)
    return op.pct_change(v.bars(), v.bench(), ["sym"])


@query(
    "vol_ratio",
    "sym ts:t vol_ratio:f6",
    f"SELECT sym, ts, CASE WHEN b > 0 THEN a / b END AS vol_ratio FROM (SELECT *, {_rv(2, '1')} AS a, {_rv(24, '1')} AS b FROM nrets)",
)
def _(spark, d):
    return op.vol_ratio(Views(spark, d).bars(), ["sym"])


def _flow(n):
    f = _pre(n)
    return f"""SELECT sym, ts, {n} AS n, buy, sell, buy - sell AS delta, CASE WHEN sell > 0 THEN buy / sell END AS ratio,
      (close - o) / o * 100 AS chg_pct, (buy - sell) * 100 / nullif(vol, 0) AS delta_vs_vol FROM (
        SELECT sym, ts, close, first(open) OVER {f} AS o, sum(taker_buy_base) OVER {f} AS buy, sum(volume) OVER {f} AS vol,
               sum(greatest(volume - taker_buy_base, 0)) OVER {f} AS sell FROM bars)"""


@query(
    "taker_flow",
    "sym ts:t n:i buy:f2 sell:f2 delta:f2 ratio:f6 chg_pct:f6 delta_vs_vol:f6",
    " UNION ALL ".join(_flow(n) for n in (1, 4, 12, 24)),
)
def _(spark, d):
    return op.taker_flow(Views(spark, d).bars(), ["sym"])


@query(
    "rotation_signal",
    "sym ts:t share:f6 avg_day:f6 avg_week:f6 vol_day:f2 chg_week_pct:f6 signal",
    f"""SELECT *, CASE WHEN avg_day > 0.54 THEN 'BTC_TO_ETH' WHEN avg_day < 0.46 THEN 'ETH_TO_BTC' ELSE 'BALANCED' END AS signal FROM (
        SELECT sym, ts, share, avg(share) OVER {_pre(24)} AS avg_day, avg(share) OVER {_pre(168)} AS avg_week,
               sum(volume) OVER {_pre(24)} AS vol_day,
               (close - first(close) OVER {_pre(168)}) / first(close) OVER {_pre(168)} * 100 AS chg_week_pct
        FROM (SELECT *, taker_buy_base / volume AS share FROM bars WHERE volume > 0))""",
)
def _(spark, d):
    return op.rotation_signal(Views(spark, d).bars(), ["sym"])


CROSS = f"""SELECT *, CASE WHEN pk <= pd AND fast_k > fast_d THEN 'up' WHEN pk >= pd AND fast_k < fast_d THEN 'down' END AS x
    FROM (SELECT *, lag(fast_k) OVER w AS pk, lag(fast_d) OVER w AS pd FROM %s {W})"""


@query(
    "cross_detect",
    "sym ts:t fast_k:f6 fast_d:f6 turn",
    f"SELECT sym, ts, fast_k, fast_d, x AS turn FROM ({CROSS % 'stoch_live'}) WHERE x IS NOT NULL",
)
def _(spark, d):
    return op.cross_detect(Views(spark, d).bars(), ["sym"], op.LIVE["slow"], op.LIVE["fast"])


VIEWS["trig"] = f"""SELECT * FROM (SELECT *, rn - 1 AS pos, CASE WHEN slow_k IS NULL THEN NULL
      WHEN x = 'up' AND fast_k < 30 AND slow_k < 40 THEN 'long' WHEN x = 'down' AND fast_k > 70 AND slow_k > 60 THEN 'short' END AS side
    FROM ({CROSS % "stoch_short"})) WHERE side IS NOT NULL"""
VIEWS["dedup"] = """
  WITH RECURSIVE kept(sym, side, pos) AS (
    SELECT sym, side, min(pos) FROM trig GROUP BY sym, side
    UNION ALL
    SELECT k.sym, k.side, (SELECT min(t.pos) FROM trig t WHERE t.sym = k.sym AND t.side = k.side AND t.pos >= k.pos + 6)
    FROM kept k WHERE k.pos IS NOT NULL)
  SELECT trig.* FROM trig JOIN kept USING (sym, side, pos)"""


def triggers(v: Views):
    return op.stoch_triggers(v.bars(), ["sym"], SHORT["slow"], SHORT["fast"])


@query("stoch_triggers", "sym ts:t pos:i side fast_k:f6 slow_k:f6", "SELECT * FROM trig")
def _(spark, d):
    return triggers(Views(spark, d))


@query("dedup_triggers", "sym ts:t pos:i side", "SELECT * FROM dedup")
def _(spark, d):
    return op.dedup_triggers(triggers(Views(spark, d)), ["sym"], 6)


@query(
    "forward_return",
    "sym ts:t fwd_1:f9 fwd_4:f9 fwd_24:f9",
    "SELECT sym, ts, "
    + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS fwd_{h}" for h in (1, 4, 24))
    + f" FROM bars {W}",
)
def _(spark, d):
    return op.forward_return(Views(spark, d).bars(), ["sym"], [1, 4, 24])


VIEWS["zone"] = f"""
  SELECT z.*, z.rn - a.rn AS anchor_bars, a.ts AS anchor_ts, a.close AS anchor_close, a.oi AS anchor_oi, a.oi_fine AS anchor_oi_fine
  FROM (SELECT *, last(CASE WHEN direction = 'short' THEN NULL ELSE rn END IGNORE NULLS) OVER w AS out_short,
               last(CASE WHEN direction = 'long' THEN NULL ELSE rn END IGNORE NULLS) OVER w AS out_long
        FROM (SELECT *, CASE WHEN fast_k >= 80 THEN 'short' WHEN fast_k <= 20 THEN 'long' END AS direction FROM stoch_zone) {W}) z
  JOIN nbars a ON a.sym = z.sym AND a.rn = CASE WHEN direction = 'short' THEN out_short ELSE out_long END
  WHERE direction IS NOT NULL"""


@query("zone_anchor", "sym ts:t direction fast_k:f6 anchor_ts:t anchor_bars:i", "SELECT * FROM zone")
def _(spark, d):
    return op.zone_anchor(Views(spark, d).bars(), ["sym"], FAST_ZONE)


def _cut_case(i):
    text = "CASE "
    for direction, names in op.CUT_LABELS.items():
        for s, pair in enumerate(names):
            text += f"WHEN direction = '{direction}' AND step = {s} THEN '{pair[i]}' "
    return text + "END"


VIEWS["cut"] = f"""
  SELECT *, CASE WHEN oi_pct IS NULL THEN 'OI no disponible para el corte' ELSE {_cut_case(0)} END AS label, {_cut_case(1)} AS quality
  FROM (SELECT *, CASE WHEN oi_pct > 0.10 THEN CASE WHEN ratio < 1 THEN 0 WHEN ratio < 2 THEN 1 WHEN ratio < 5 THEN 2 ELSE 3 END
               WHEN oi_pct >= -0.10 THEN 4 WHEN oi_pct < -0.10 THEN 5 END AS step
        FROM (SELECT *, CASE WHEN abs(oi_pct) > 0.01 THEN abs(price_pct) / abs(oi_pct) END AS ratio
              FROM (SELECT *, (close - anchor_close) / nullif(anchor_close, 0) * 100 AS price_pct,
                           CASE WHEN fine THEN (oi_fine - anchor_oi_fine) / anchor_oi_fine * 100 ELSE (oi - anchor_oi) / anchor_oi * 100 END AS oi_pct,
                           CASE WHEN fine THEN 'fine' ELSE 'coarse' END AS oi_source
                    FROM (SELECT *, oi_fine IS NOT NULL AND anchor_oi_fine IS NOT NULL AS fine FROM zone))))"""


@query(
    "cut_anchored_mq",
    "sym ts:t direction anchor_ts:t anchor_bars:i price_pct:f6 oi_pct:f6 ratio:f9 label quality oi_source",
    "SELECT * FROM cut",
)
def _(spark, d):
    return op.cut_anchored_mq(Views(spark, d).bars(), ["sym"], FAST_ZONE)


def _mqw(name, h, weight):
    price = (
        f"(close - lag(close, {h}) OVER w) / lag(close, {h}) OVER w * 100"
        if name in op.MQ_LONG
        else f"(close - first(open) OVER {_pre(h)}) / first(open) OVER {_pre(h)} * 100"
    )
    return f"""SELECT sym, ts, '{name}' AS win, {weight}e0 AS weight, round({price}, 3) AS price_pct,
        (oi - lag(oi, {h}) OVER w) / lag(oi, {h}) OVER w * 100 AS oi_pct FROM bars {W}"""


VIEWS["mqw"] = f"""
  SELECT *, CASE WHEN abs(oi_pct) > 0.01 THEN abs(price_pct) / abs(oi_pct) END AS ratio
  FROM ({" UNION ALL ".join(_mqw(n, *p) for n, p in op.MQ_WINDOWS.items())}) WHERE oi_pct IS NOT NULL"""
VIEWS["mq"] = """
  SELECT *, CASE
      WHEN pu AND ou THEN CASE WHEN ratio < 1 THEN 'Acumulación real' WHEN ratio < 2 THEN 'Balanceado (longs mixto)'
                               WHEN ratio < 5 THEN 'Covering dominante' ELSE 'Squeeze puro' END
      WHEN pu AND od THEN 'Distribución arriba (OI cae)' WHEN pu THEN 'Short covering (OI plano)'
      WHEN pd AND ou THEN CASE WHEN ratio < 1 THEN 'Distribución real' WHEN ratio < 2 THEN 'Balanceado (shorts mixto)'
                               WHEN ratio < 5 THEN 'Liquidation dominante' ELSE 'Long squeeze puro' END
      WHEN pd AND od THEN 'Long capitulation' WHEN pd THEN 'Long cerrando (OI plano)'
      WHEN ou THEN 'Build-up (lateral)' WHEN od THEN 'Deleverage (lateral)' ELSE 'Sin actividad' END AS label,
    CASE WHEN pu AND NOT od THEN 'bullish' WHEN pd THEN 'bearish' ELSE 'neutral' END AS direction,
    CASE WHEN (pu OR pd) AND ou AND ratio < 1 THEN 'high' WHEN (pu OR pd) AND ou AND ratio < 2 THEN 'medium'
         WHEN pd AND od THEN 'high' WHEN NOT pu AND NOT pd AND (ou OR od) THEN 'medium' ELSE 'low' END AS quality
  FROM (SELECT *, price_pct > 0.05 AS pu, price_pct < -0.05 AS pd, oi_pct > 0.10 AS ou, oi_pct < -0.10 AS od FROM mqw)"""


@query(
    "money_quality",
    "sym ts:t win price_pct:f3 oi_pct:f6 ratio:f9 label direction quality",
    "SELECT * FROM mq",
)
def _(spark, d):
    return op.money_quality(Views(spark, d).bars(), ["sym"])


VIEWS["mqv"] = """
  SELECT *, CASE WHEN score > 0.4 THEN 'ALCISTA con plata nueva' WHEN score > 0.15 THEN 'Alcista débil / covering'
                 WHEN score < -0.4 THEN 'BAJISTA con plata nueva' WHEN score < -0.15 THEN 'Bajista débil / covering'
                 ELSE 'Lateral / rotación' END AS verdict
  FROM (SELECT sym, ts, round(sum(CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * weight *
                            CASE quality WHEN 'high' THEN 1.0e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END) / sum(weight), 9) AS score
        FROM mq GROUP BY sym, ts)"""


@query(
    "money_quality_verdict",
    "sym ts:t score:f6 verdict rate:f9 context",
    """SELECT v.*, f.rate, CASE WHEN f.rate < -0.00005 THEN 'Funding negativo — shorts cargados'
              WHEN f.rate > 0.00008 THEN 'Funding positivo — longs cargados' WHEN f.rate IS NOT NULL THEN 'Funding neutro' END AS context
       FROM mqv v ASOF LEFT JOIN (SELECT * FROM funding WHERE venue = 'v0') f ON v.ts >= f.ts""",
)
def _(spark, d):
    from ..plans.ordered import asof_join

    v = Views(spark, d)
    verdict = op.money_quality_verdict(op.money_quality(v.bars(), ["sym"]), ["sym"])
    joined = asof_join(verdict, v.funding().filter("venue = 'v0'"), [], ["rate"])
    return joined.withColumn("context", op.funding_context("rate"))


@query("last_n", "sym ts:t close:f6", "SELECT sym, ts, close FROM nbars WHERE nn - rn < 48")
def _(spark, d):
    return op.last_rows(Views(spark, d).bars(), ["sym"], 48)
