from pyspark.sql import functions as F

from ..operators import book as bk
from ..plans.ordered import asof_join, top_k
from ..sources import sinks
from ..sources.views import Views
from ..streaming import jobs
from .book_profile import clusters
from .registry import query
from .regimes import FEATURES, KEY, MIN_ROWS, SEEDS
from .sources import scratch
from .views import VIEWS


@query(
    "flatten_snapshot",
    "sym ts:t px:f6 flags_buy:i flags_big:i by_tf_h1_k:i by_tf_h1_more path",
    """SELECT sym, ts, px, CAST(taker_buy AS INT) AS flags_buy, CAST(k >= 50 AS INT) AS flags_big, k AS by_tf_h1_k,
              concat('{"a":', k, ',"b":"', sym, '"}') AS by_tf_h1_more, concat('[', k, ',', seq, ']') AS path FROM ticks""",
)
def _(spark, d):
    t = Views(spark, d).ticks()
    deep = F.struct(F.col("k").alias("a"), F.col("sym").alias("b"))
    nested = t.select(
        "sym", "ts", "px", F.struct(F.col("taker_buy").alias("buy"), (F.col("k") >= 50).alias("big")).alias("flags"),
        F.struct(F.struct(F.col("k"), deep.alias("more")).alias("h1")).alias("by_tf"), F.array("k", "seq").alias("path"),
    )
    return sinks.flatten_snapshot(nested)


@query(
    "sink_daily_parquet",
    "sym ts:t px:f6 extra:f6 day:t",
    "SELECT sym, ts, px, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN qty END AS extra, date_trunc('day', ts) AS day FROM ticks",
)
def _(spark, d):
    """Two appends; the second brings a new column."""
    t = Views(spark, d).ticks().select("sym", "ts", "px", "qty")
    path = scratch(spark, "daily")
    cut = F.lit("2024-01-16").cast("timestamp")
    sinks.write_daily(t.filter(F.col("ts") < cut).drop("qty"), path)
    sinks.write_daily(t.filter(F.col("ts") >= cut).withColumnRenamed("qty", "extra"), path)
    return sinks.read_daily(spark, path)


@query("sink_batches", "sym ts:t seq:i px:f6 day:t", "SELECT sym, ts, seq, px, date_trunc('day', ts) AS day FROM ticks")
def _(spark, d):
    """Two micro-batches; the first is replayed."""
    t = Views(spark, d).ticks().select("sym", "ts", "seq", "px")
    path = scratch(spark, "batches")
    for batch in (0, 0, 1):
        sinks.write_batch(t.filter(F.pmod("seq", F.lit(2)) == batch), path, f"ticks-{batch}")
    return sinks.read_batches(spark, path)


@query(
    "sink_micro",
    "snap:t mid:f4 total_bid:f2 total_ask:f2 n_bids:i n_asks:i best_bid_qty:f2 n_bid_walls:i n_ask_walls:i",
    """SELECT snap, mid, total_bid, total_ask, least(nb, 30) AS n_bids, least(na, 30) AS n_asks, bq AS best_bid_qty, least(coalesce(wb, 0), 30) AS n_bid_walls, least(coalesce(wa, 0), 30) AS n_ask_walls
       FROM book_sum JOIN (SELECT snap, count_if(side = 'bid') AS nb, count_if(side = 'ask') AS na, first(qty ORDER BY price DESC) FILTER (side = 'bid') AS bq FROM clusters GROUP BY snap) USING (snap)
       LEFT JOIN (SELECT snap, count_if(side = 'bid') AS wb, count_if(side = 'ask') AS wa FROM walls GROUP BY snap) USING (snap)""",
)
def _(spark, d):
    c = clusters(Views(spark, d))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    ranked = bk.topk_levels(c, ["snap"], 30)
    walls = top_k(bk.book_walls(c, ["snap"], 1.5), ["snap", "side"], [best], 30)
    rows = sinks.micro_rows(bk.book_summary(c, ["snap"]), ranked, walls, ["snap"])
    path = scratch(spark, "micro")
    sinks.write_daily(rows, path, "snap")
    size = lambda x: F.json_array_length(x)
    some = lambda x: F.coalesce(size(x), F.lit(0))
    return sinks.read_daily(spark, path).withColumns(
        {
            "n_bids": size("bids_json"), "n_asks": size("asks_json"),
            "best_bid_qty": F.get_json_object("bids_json", "$[0].qty").cast("double"),
            "n_bid_walls": some("bid_walls_json"), "n_ask_walls": some("ask_walls_json"),
        }
    )


@query(
    "sink_source_tables",
    "label ts:t close:f6 n:i",
    "SELECT label, ts, close, CAST(NULL AS BIGINT) AS n FROM macro WHERE label < '3' UNION ALL SELECT o_orderpriority, o_orderdate, NULL, count(*) FROM orders WHERE o_orderpriority >= '3' GROUP BY ALL",
)
def _(spark, d):
    v = Views(spark, d)
    counts = v.orders().filter("o_orderpriority >= '3'").groupBy(
        F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "sources")
    sinks.write_source_tables({"macro": [v.macro().filter("label < '3'"), counts]}, path)
    return spark.read.parquet(f"{path}/macro")


@query("sink_state_log", "sym seq:i score:i price:f6 stamped day:t", "SELECT sym, seq, score, price, true AS stamped, date_trunc('day', ts) AS day FROM state_log")
def _(spark, d):
    path = scratch(spark, "state")
    sinks.write_state_log(Views(spark, d).state_log(), path)
    schema = "sym string, seq bigint, score int, price double, logged_at timestamp, day date"
    return spark.read.schema(schema).json(path).withColumn("stamped", F.col("logged_at").isNotNull())


@query("sink_model_snapshot", "sym fit_date:t k:i seed:i n_obs:i")
def _(spark, d):
    from ..operators import regimes as rg
    from .indicators import features

    f = features(Views(spark, d))
    m = rg.best_models(rg.hmm_fit_grid(f, KEY, FEATURES, [4], SEEDS[:2], n_iter=50, tol=1e-2, min_rows=MIN_ROWS), KEY)
    path = scratch(spark, "models")
    m = m.withColumn("fit_date", F.to_date("last_ts"))
    sinks.write_models(m, path)
    return spark.read.schema(m.schema).parquet(path)


# -- batch twins of the streaming jobs -----------------------------------------------------------------------------


@query("st_tumbling_bars", "sym ts:t open:f6 high:f6 low:f6 close:f6 volume:f2 taker_buy_base:f2", "SELECT * FROM bars")
def _(spark, d):
    return jobs.tumbling_bars(Views(spark, d).ticks(), ["sym"])


VIEWS["steps"] = """
  SELECT sym, make_timestamp(CAST(epoch_us(ts) // 3600000000 AS BIGINT) * 3600000000) AS s, sum(CASE WHEN taker_buy THEN qty ELSE 0 END) AS buy, sum(qty) AS vol FROM ticks GROUP BY ALL"""


@query(
    "st_sliding_flow",
    "sym start:t end_ts:t buy:f2 sell:f2 delta:f2 ratio:f9",
    """SELECT sym, start, start + INTERVAL 4 HOUR AS end_ts, buy, vol - buy AS sell, 2 * buy - vol AS delta, CASE WHEN vol > buy THEN buy / (vol - buy) END AS ratio
       FROM (SELECT sym, s - to_hours(CAST(o AS INTEGER)) AS start, sum(buy) AS buy, sum(vol) AS vol FROM steps, range(0, 4) AS r(o) GROUP BY ALL)""",
)
def _(spark, d):
    return jobs.sliding_flow(Views(spark, d).ticks(), ["sym"], "4 hours", "1 hour")


@query(
    "st_depth_summary",
    "sym slot:t ts:t px:f6 qty:f2",
    """SELECT *, make_timestamp(CAST(epoch_us(ts) // 300000000 AS BIGINT) * 300000000) AS slot FROM ticks
       QUALIFY row_number() OVER (PARTITION BY sym, epoch_us(ts) // 300000000 ORDER BY ts DESC, px DESC, qty DESC) = 1""",
)
def _(spark, d):
    return jobs.depth_summary(Views(spark, d).ticks(), ["sym"], ["px", "qty"])


@query(
    "st_depth_history",
    "sym slot:t ts:t px:f6 qty:f2",
    """SELECT * FROM (
         SELECT *, make_timestamp(CAST(epoch_us(ts) // 300000000 AS BIGINT) * 300000000) AS slot FROM ticks
         QUALIFY row_number() OVER (PARTITION BY sym, epoch_us(ts) // 300000000 ORDER BY ts DESC, px DESC, qty DESC) = 1)
       QUALIFY row_number() OVER (PARTITION BY sym ORDER BY slot DESC) <= 48""",
)
def _(spark, d):
    return jobs.last_summaries(Views(spark, d).ticks(), ["sym"], ["px", "qty"])


@query(
    "st_minute_dedup",
    "sym minute:t seq:i px:f6",
    "SELECT *, date_trunc('minute', ts) AS minute FROM ticks QUALIFY row_number() OVER (PARTITION BY sym, date_trunc('minute', ts) ORDER BY ts, seq) = 1",
)
def _(spark, d):
    return jobs.first_per_minute(Views(spark, d).ticks(), ["sym"], ["ts", "seq"])


@query(
    "st_throttle_change",
    "period ts:t seq:i score:i",
    """WITH RECURSIVE rows_in AS (
         SELECT period, ts, seq, floor(score / 6.0e0) AS score, epoch_us(ts) AS us, row_number() OVER (PARTITION BY period ORDER BY ts, seq) AS rn FROM state_log),
       turns AS (SELECT *, CASE WHEN lag(score) OVER (PARTITION BY period ORDER BY rn) IS DISTINCT FROM score THEN rn END AS turn FROM rows_in),
       jumps AS (SELECT period, rn, least(
           min(turn) OVER (PARTITION BY period ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
           min(rn) OVER (PARTITION BY period ORDER BY us RANGE BETWEEN 1800000001 FOLLOWING AND UNBOUNDED FOLLOWING)) AS nxt FROM turns),
       hit AS (SELECT DISTINCT period, CAST(1 AS BIGINT) AS rn FROM rows_in
         UNION ALL SELECT j.period, j.nxt FROM hit JOIN jumps j USING (period, rn) WHERE j.nxt IS NOT NULL)
       SELECT period, ts, seq, score FROM hit JOIN rows_in USING (period, rn)""",
)
def _(spark, d):
    return jobs.throttle_batch(Views(spark, d).state_log().withColumn("score", F.floor(F.col("score") / 6)), ["period"], 1800)


@query(
    "st_asof_enrich",
    "sym ts:t close:f6 rate:f9 btc:f6",
    """SELECT b.sym, b.ts, b.close, f.rate, x.btc FROM bars b ASOF LEFT JOIN (SELECT * FROM funding WHERE venue = 'v0') f ON b.ts >= f.ts
       ASOF LEFT JOIN bench x ON b.ts >= x.ts""",
)
def _(spark, d):
    v = Views(spark, d)
    return asof_join(v.bars(), [(v.funding().filter("venue = 'v0'"), ["rate"]), (v.bench(), ["btc"])], [])
