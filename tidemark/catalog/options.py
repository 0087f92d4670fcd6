from pyspark.sql import functions as F

from ..functions.exprs import CDF_DEN, CDF_NUM, bs_delta, bs_gamma
from ..operators import indicators as ind
from ..operators import options as op
from ..sources.views import SPOT, Views
from .registry import query
from .views import VIEWS

def as_of():
    return F.lit("1998-01-01 00:00:00").cast("timestamp")


def cdf_sql(x: str) -> str:
    def poly(coeffs):
        text = repr(coeffs[0])
        for k in coeffs[1:]:
            text = f"({text}) * abs({x}) + CAST({k!r} AS DOUBLE)"
        return text

    e = f"exp(-abs({x}) * abs({x}) / 2)"
    near = f"{e} * ({poly(CDF_NUM)}) / ({poly(CDF_DEN)})"
    a = f"abs({x})"
    far = f"{e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65e0))))) / 2.506628274631e0"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


VIEWS["opt_d"] = """
  SELECT *, floor(epoch(expiry - TIMESTAMP '1998-01-01') / 86400) AS dte,
         (epoch(expiry - TIMESTAMP '1998-01-01') + 8 * 3600) / 86400.0e0 AS dte8 FROM options"""
VIEWS["expo"] = """
  SELECT *, CASE WHEN is_call THEN 1 ELSE -1 END * oi * gamma * 1500.0e0 * 1500.0e0 AS gex FROM (
    SELECT *, CASE WHEN t > 0 AND s > 0 THEN exp(-0.5e0 * d1 * d1) / sqrt(2 * pi()) / (1500.0e0 * s * sqrt(t)) ELSE 0 END AS gamma FROM (
      SELECT *, CASE WHEN t > 0 AND s > 0 THEN (ln(1500.0e0 / strike) + 0.5e0 * s * s * t) / (s * sqrt(t)) END AS d1 FROM (
        SELECT *, dte / 365.0e0 AS t, iv / 100.0e0 AS s FROM opt_d WHERE dte BETWEEN 0 AND 60 AND oi > 0)))"""
VIEWS["by_strike"] = """
  SELECT und, strike, sum(gex) AS gex, sum(CASE WHEN is_call THEN oi ELSE 0 END) AS call_oi,
         sum(CASE WHEN is_call THEN 0 ELSE oi END) AS put_oi FROM expo GROUP BY und, strike"""
VIEWS["flip"] = """
  SELECT und, coalesce(min_by(cross_at, strike) FILTER (cross_at IS NOT NULL), CASE WHEN max(gex) < 0 THEN max(strike) END,
                       CASE WHEN min(gex) >= 0 THEN min(strike) END) AS flip, sum(gex) AS total_gex
  FROM (SELECT *, CASE WHEN pg < 0 AND gex >= 0 THEN p + (strike - p) * (-pg / (gex - pg)) END AS cross_at
        FROM (SELECT *, lag(strike) OVER w AS p, lag(gex) OVER w AS pg FROM by_strike WINDOW w AS (PARTITION BY und ORDER BY strike)))
  GROUP BY und"""
VIEWS["term"] = """
  SELECT und, dte, sum(iv * w) / sum(w) AS iv FROM (
    SELECT *, greatest(1 - m * 5, 0.1e0) * oi AS w FROM (SELECT *, abs(strike - 1500) / 1500.0e0 AS m FROM opt_d)
    WHERE dte BETWEEN 0 AND 180 AND iv > 0 AND oi > 0 AND m <= 0.20e0) GROUP BY und, dte"""


def exposed(v: Views):
    return op.exposures(v.options(), as_of(), SPOT)


def by_strike(v: Views):
    return op.gex_by_strike(exposed(v), ["und"])


@query("iv_term_structure", "und dte:i iv:f6", "SELECT * FROM term")
def _(spark, d):
    return op.iv_term_structure(Views(spark, d).options(), ["und"], as_of(), SPOT)


@query("gex_by_strike", "und strike:f2 gex:f4 call_oi:f2 put_oi:f2", "SELECT * FROM by_strike")
def _(spark, d):
    return by_strike(Views(spark, d))


@query(
    "gex_bars",
    "und bucket:f2 expiry:t gex:f4 call_oi:f2 put_oi:f2 overall:i",
    """SELECT und, bucket, expiry, sum(gex) AS gex, sum(CASE WHEN is_call THEN oi ELSE 0 END) AS call_oi,
              sum(CASE WHEN is_call THEN 0 ELSE oi END) AS put_oi, grouping(expiry) AS overall
       FROM (SELECT *, round_even(strike / 50.0e0, 0) * 50.0e0 AS bucket FROM expo WHERE strike BETWEEN 1275 AND 1725)
       GROUP BY GROUPING SETS ((und, bucket), (und, bucket, expiry))""",
)
def _(spark, d):
    return op.gex_bars(exposed(Views(spark, d)), ["und"], SPOT)


@query("gamma_flip", "und flip:f6 total_gex:f4", "SELECT * FROM flip")
def _(spark, d):
    return op.gamma_flip(by_strike(Views(spark, d)), ["und"])


@query(
    "option_walls",
    "und call_wall:f2 put_wall:f2 call_dist:f6 put_dist:f6",
    """SELECT *, (call_wall - 1500) / 1500.0e0 * 100 AS call_dist, (put_wall - 1500) / 1500.0e0 * 100 AS put_dist FROM (
         SELECT und, (first(strike ORDER BY call_oi DESC, strike) FILTER (strike > 1500)) AS call_wall,
                (first(strike ORDER BY put_oi DESC, strike) FILTER (strike < 1500)) AS put_wall
         FROM by_strike WHERE strike BETWEEN 1200 AND 1800 GROUP BY und)""",
)
def _(spark, d):
    return op.option_walls(by_strike(Views(spark, d)), ["und"], SPOT)


@query(
    "gex_zones",
    "und zone call_oi:f2 put_oi:f2 net_gex_m:f6 call_pct:f6 dominant",
    """SELECT *, call_oi * 100 / nullif(call_oi + put_oi, 0) AS call_pct, CASE WHEN put_oi > call_oi THEN 'puts' ELSE 'calls' END AS dominant
       FROM (SELECT und, CASE WHEN strike >= coalesce(flip, 1500) THEN 'above' ELSE 'below' END AS zone, sum(gex) / 1e6 AS net_gex_m,
                    sum(CASE WHEN is_call THEN oi ELSE 0 END) AS call_oi, sum(CASE WHEN is_call THEN 0 ELSE oi END) AS put_oi
             FROM expo LEFT JOIN flip USING (und) WHERE strike BETWEEN 1275 AND 1725 GROUP BY ALL)""",
)
def _(spark, d):
    e = exposed(Views(spark, d))
    return op.gex_zones(e, op.gamma_flip(op.gex_by_strike(e, ["und"]), ["und"]), ["und"], SPOT)


@query(
    "max_pain",
    "und expiry:t max_pain:f2 pay:f2",
    """SELECT und, expiry, first(strike ORDER BY pay, strike) AS max_pain, min(pay) AS pay FROM (
         SELECT t.und, t.expiry, t.strike, sum(CASE WHEN o.is_call THEN greatest(t.strike - o.strike, 0) ELSE greatest(o.strike - t.strike, 0) END * o.oi) AS pay
         FROM (SELECT DISTINCT und, expiry, strike FROM expo) t JOIN expo o ON o.und = t.und AND o.expiry = t.expiry GROUP BY ALL)
       GROUP BY und, expiry""",
)
def _(spark, d):
    return op.max_pain(Views(spark, d).options(), ["und"], as_of())


@query(
    "option_expiries",
    "und expiry:t dte:f6 call_oi:f2 put_oi:f2 total_oi:f2 notional:f2 put_call:f9 pin_oi:f2 pin_risk:f6 agg_put_call:f9 largest",
    """SELECT *, sum(put_oi) OVER p / nullif(sum(call_oi) OVER p, 0) AS agg_put_call,
              row_number() OVER (PARTITION BY und ORDER BY notional DESC, dte) = 1 AS largest
       FROM (SELECT *, total_oi * 1500 AS notional, put_oi / nullif(call_oi, 0) AS put_call, pin_oi / sqrt(greatest(dte, 0.25e0)) AS pin_risk
             FROM (SELECT und, expiry, dte8 AS dte, sum(oi) AS total_oi, sum(CASE WHEN is_call THEN oi ELSE 0 END) AS call_oi,
                          sum(CASE WHEN is_call THEN 0 ELSE oi END) AS put_oi, sum(CASE WHEN strike BETWEEN 1470 AND 1530 THEN oi ELSE 0 END) AS pin_oi
                   FROM opt_d WHERE dte8 > 0 GROUP BY ALL HAVING sum(oi) > 0)
             QUALIFY row_number() OVER (PARTITION BY und ORDER BY dte) <= 8)
       WINDOW p AS (PARTITION BY und)""",
)
def _(spark, d):
    return op.option_expiries(Views(spark, d).options(), ["und"], as_of(), SPOT)


VIEWS["delta_in"] = """
  SELECT *, (ln(1500.0e0 / strike) + (0.04e0 + 0.5e0 * v * v) * t) / (v * sqrt(t)) AS d1 FROM (
    SELECT *, iv / 100.0e0 AS v, dte8 / 365.25e0 AS t FROM opt_d WHERE strike BETWEEN 1050 AND 1950 AND iv > 0 AND dte8 > 0)"""
VIEWS["deltas"] = f"SELECT *, {cdf_sql('d1')} - CASE WHEN is_call THEN 0 ELSE 1 END AS delta FROM delta_in"
VIEWS["skew"] = """
  SELECT *, iv_call25 - iv_put25 AS rr25, 0.5e0 * (iv_call25 + iv_put25) - iv_atm AS bf25 FROM (
    SELECT und, expiry, dte8 AS dte, count(*) AS strikes, first(v ORDER BY abs(strike - 1500), NOT is_call, strike) AS iv_atm,
           coalesce(first(vi ORDER BY strike) FILTER (hit AND is_call), first(v ORDER BY off, strike) FILTER (off <= 0.12e0 AND is_call)) AS iv_call25,
           coalesce(first(vi ORDER BY strike) FILTER (hit AND NOT is_call), first(v ORDER BY off, strike) FILTER (off <= 0.12e0 AND NOT is_call)) AS iv_put25
    FROM (SELECT *, round(abs(delta - target), 12) AS off,
                 (delta >= target AND target >= d_next) OR (delta <= target AND target <= d_next) AS hit,
                 CASE WHEN d_next = delta THEN v ELSE v + (target - delta) / (d_next - delta) * (v_next - v) END AS vi
          FROM (SELECT *, CASE WHEN is_call THEN 0.25e0 ELSE -0.25e0 END AS target, lead(delta) OVER w AS d_next, lead(v) OVER w AS v_next
                FROM deltas WINDOW w AS (PARTITION BY und, expiry, is_call ORDER BY strike)))
    GROUP BY und, expiry, dte8 HAVING count_if(is_call) BETWEEN 1 AND count(*) - 1)"""
SKEW = "expiry:t dte:f6 iv_atm:f6 iv_call25:f6 iv_put25:f6 rr25:f6 bf25:f6 strikes:i"


def skew(v: Views):
    return op.option_skew(v.options(), ["und"], as_of(), SPOT)


VIEWS["tenors"] = """
  SELECT * FROM skew, (VALUES (7), (30), (60), (90)) AS d(tenor)
  QUALIFY row_number() OVER (PARTITION BY und, tenor ORDER BY abs(dte - tenor), dte) = 1"""


@query(
    "option_skew",
    "und tenor:i " + SKEW,
    "SELECT und, 0 AS tenor, * EXCLUDE (und) FROM skew UNION ALL BY NAME SELECT * FROM tenors",
)
def _(spark, d):
    s = skew(Views(spark, d))
    return s.withColumn("tenor", F.lit(0)).unionByName(op.skew_tenors(s, ["und"]))


@query(
    "bs_gamma",
    "und expiry:t strike:f2 is_call gamma:f9",
    "SELECT * FROM expo",
)
def _(spark, d):
    o = Views(spark, d).options().withColumn("dte", op.days_left(as_of())).filter("dte BETWEEN 0 AND 60 AND oi > 0")
    return o.withColumn("gamma", bs_gamma(F.lit(SPOT), F.col("strike"), F.col("dte") / 365.0, F.col("iv") / 100.0))


@query("bs_delta", "und expiry:t strike:f2 is_call delta:f9", "SELECT * FROM deltas")
def _(spark, d):
    o = op.moneyness(Views(spark, d).options(), SPOT, 0.30).withColumn("t", op.days_left(as_of(), 8) / 365.25)
    v = F.col("iv") / 100.0
    return o.filter("t > 0").withColumn(
        "delta", bs_delta(F.lit(SPOT), F.col("strike"), F.col("t"), F.lit(0.04), v, F.col("is_call"))
    )


@query("f_moneyness", "und expiry:t strike:f2 is_call oi:f2 iv:f6", "SELECT * FROM options WHERE strike BETWEEN 1350 AND 1650")
def _(spark, d):
    return op.moneyness(Views(spark, d).options(), SPOT, 0.10)


@query(
    "gex_impact",
    "und total_gex:f4 vol_24h:f2 hedge_pct:f6 impact",
    """SELECT *, CASE WHEN hedge_pct >= 10 THEN 'ALTO' WHEN hedge_pct >= 3 THEN 'MODERADO' ELSE 'BAJO' END AS impact
       FROM (SELECT *, abs(total_gex) * 0.01e0 * 100 / (vol_24h / 24) AS hedge_pct
             FROM flip JOIN (SELECT concat('u', o_custkey % 2) AS und, sum(o_totalprice) AS vol_24h FROM orders GROUP BY 1) USING (und))""",
)
def _(spark, d):
    v = Views(spark, d)
    vol = v.orders().groupBy(F.concat(F.lit("u"), F.col("o_custkey") % 2).alias("und")).agg(
        F.sum("o_totalprice").alias("vol_24h")
    )
    return op.gex_impact(op.gamma_flip(by_strike(v), ["und"]), vol, ["und"])


@query(
    "iv_rv_spread",
    "sym und dte:i iv:f6 rv:f6 spread:f6 ratio:f6",
    """SELECT *, iv - rv AS spread, iv / rv AS ratio FROM (
         SELECT und, first(iv ORDER BY dte) AS iv, min(dte) AS dte FROM term WHERE dte BETWEEN 3 AND 21 GROUP BY und)
       JOIN (SELECT sym, concat('u', length(sym) % 2) AS und, stddev_samp(ret) * sqrt(8760) * 100 AS rv
             FROM nrets WHERE nn - rn < 24 GROUP BY sym HAVING count(ret) = 24) USING (und)""",
)
def _(spark, d):
    v = Views(spark, d)
    und = F.concat(F.lit("u"), F.length("sym") % 2)  # every symbol has the options of one underlying
    rv = ind.realized_vol(v.bars(), ["sym"], (4, 24)).groupBy("sym", und.alias("und")).agg(F.max_by("rv_24", "ts").alias("rv"))
    return op.iv_rv_spread(op.iv_term_structure(v.options(), ["und"], as_of(), SPOT), rv.filter("rv IS NOT NULL"), ["und"])


VIEWS["symbols"] = """
  SELECT DISTINCT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'ETH' ELSE 'BTC' END, '-', strftime(l_shipdate, '%-d'), upper(strftime(l_shipdate, '%b')), strftime(l_shipdate, '%y'),
         CASE WHEN l_linenumber = 1 THEN '' ELSE concat('-', 500 + 50 * (l_partkey % 41), '-', CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END) END) AS instrument
  FROM lineitem"""


def symbols(v: Views):
    day = F.col("l_shipdate")
    tail = F.concat(
        F.lit("-"), (500 + 50 * (F.col("l_partkey") % 41)).cast("string"), F.lit("-"),
        F.when(F.col("l_linestatus") == "O", "C").otherwise("P"),
    )
    return (
        v.lineitem()
        .select(
            F.concat(
                F.when(F.col("l_suppkey") % 2 == 0, "ETH").otherwise("BTC"), F.lit("-"),
                F.upper(F.date_format(day, "dMMMyy")), F.when(F.col("l_linenumber") == 1, "").otherwise(tail),
            ).alias("instrument")
        )
        .distinct()
    )


@query(
    "src_option_symbols",
    "instrument und expiry:t strike:f2 is_call",
    r"""SELECT instrument, p.a AS und, strptime(p.b, '%d%b%y') + INTERVAL 8 HOUR AS expiry, CAST(nullif(p.c, '') AS DOUBLE) AS strike,
               CASE WHEN p.d <> '' THEN p.d = 'C' END AS is_call
        FROM (SELECT instrument, regexp_extract(instrument, '^([A-Z]+)-(\d{1,2}[A-Z]{3}\d{2})(?:-(\d+)-([CP]))?$', ['a', 'b', 'c', 'd']) AS p FROM symbols)""",
)
def _(spark, d):
    return op.symbol_parts(symbols(Views(spark, d)))
