from pyspark.sql import functions as F

from ..operators import book as bk
from ..operators import levels as lv
from ..operators import options as opt
from ..operators import profile as pf
from ..plans.ordered import DAY, grid_asof_join, top_k
from ..plans.settle import settle
from ..sources.views import SPOT, Views
from .options import by_strike
from .registry import query
from .views import VIEWS

VIEWS["asof_left"] = """
  SELECT o_orderpriority AS label, l_shipdate AS ts, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(
    "join_asof",
    "label ts:t l_orderkey:i l_linenumber:i quote_ts:t close:f4",
    """SELECT l.*, m.ts AS quote_ts, m.close FROM asof_left l ASOF LEFT JOIN macro m ON l.label = m.label AND l.ts >= m.ts""",
)
def _(spark, d):
    v = Views(spark, d)
    left = v.lineitem().join(v.orders(), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("label"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber"
    )
    return grid_asof_join(left, v.kept("macro"), ["label"], ["close"], DAY, right_time_as="quote_ts")


@query(
    "join_equi_inner",
    "und expiry:t strike:f2 is_call oi:f2 iv:f6",
    "SELECT * FROM options WHERE oi > 10 AND iv > 35",
)
def _(spark, d):
    o = Views(spark, d).options()
    inst = F.concat_ws("-", "und", F.date_format("expiry", "yyMMdd"), F.col("strike").cast("bigint"), F.when(F.col("is_call"), "C").otherwise("P"))
    oi = o.filter("oi > 10").select(inst.alias("inst"), "und", "expiry", "strike", "is_call", "oi")
    iv = o.filter("iv > 35").select(inst.alias("inst"), "iv")
    return oi.join(iv, "inst")


VIEWS["levels"] = """
  SELECT und AS key, flip AS price, 'Gamma Flip' AS label, 'options' AS source FROM flip WHERE flip IS NOT NULL
  UNION ALL SELECT und, first(strike ORDER BY call_oi DESC, strike) FILTER (strike > 1500), 'Call Wall', 'options' FROM by_strike WHERE strike BETWEEN 1200 AND 1800 GROUP BY und
  UNION ALL SELECT und, first(strike ORDER BY put_oi DESC, strike) FILTER (strike < 1500), 'Put Wall', 'options' FROM by_strike WHERE strike BETWEEN 1200 AND 1800 GROUP BY und
  UNION ALL SELECT concat('u', CASE WHEN sym = 'view' THEN 0 ELSE 1 END), unnest([poc, vah, val]), unnest(['POC', 'VAH', 'VAL']), 'volume' FROM vp_struct
  UNION ALL SELECT concat('u', month(snap) % 2), price, CASE WHEN side = 'bid' THEN 'Bid Wall' ELSE 'Ask Wall' END, 'orderbook' FROM walls
            QUALIFY row_number() OVER (PARTITION BY snap, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) <= 3"""


def levels(v: Views):
    per = by_strike(v)
    walls = opt.option_walls(per, ["und"], SPOT)
    lit = F.lit
    row = lambda df, key, price, label, source: df.select(key.alias("key"), price.cast("double").alias("price"), label.alias("label"), lit(source).alias("source"))
    und = F.col("und")
    vp = pf.volume_profile_struct(v.bars(), ["sym"], 0.5).select(
        F.concat(lit("u"), F.when(F.col("sym") == "view", 0).otherwise(1)).alias("key"),
        F.inline(F.array(*[F.struct(F.col(c).alias("price"), lit(c.upper()).alias("label")) for c in ("poc", "vah", "val")])),
    ).withColumn("source", lit("volume"))
    bw = bk.book_walls(bk.book_cluster(v.book(), ["snap"], 2.0), ["snap"], 1.5)
    near = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    bw = top_k(bw, ["snap", "side"], [near], 3)
    parts = [
        row(opt.gamma_flip(per, ["und"]), und, F.col("flip"), lit("Gamma Flip"), "options"),
        row(walls, und, F.col("call_wall"), lit("Call Wall"), "options"),
        row(walls, und, F.col("put_wall"), lit("Put Wall"), "options"),
        vp,
        row(bw, F.concat(lit("u"), F.month("snap") % 2), F.col("price"), F.when(F.col("side") == "bid", "Bid Wall").otherwise("Ask Wall"), "orderbook"),
    ]
    return lv.union_levels(parts, SPOT)


@query(
    "union_levels",
    "key price:f6 label source dist_pct:f6 above near",
    "SELECT *, (price - 1500) / 1500 * 100 AS dist_pct, price > 1500 AS above, abs((price - 1500) / 1500 * 100) < 1 AS near FROM levels WHERE price IS NOT NULL",
)
def _(spark, d):
    return levels(Views(spark, d))


@query(
    "join_cross_levels",
    "key price:f6 label_hi label_lo source_hi source_lo gap:f6",
    """SELECT a.key, (a.price + b.price) / 2 AS price, a.label AS label_hi, b.label AS label_lo, a.source AS source_hi, b.source AS source_lo, a.price - b.price AS gap
       FROM levels a JOIN levels b ON a.key = b.key AND a.source <> b.source AND a.price - b.price < 10 AND (a.price > b.price OR (a.price = b.price AND a.source < b.source))""",
)
def _(spark, d):
    return lv.cross_levels(settle(levels(Views(spark, d))), ["key"])
