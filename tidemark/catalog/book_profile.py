from ..operators import book as bk
from ..operators import profile as pf
from ..sources.views import Views
from .registry import query
from .views import VIEWS

VIEWS["clusters"] = """
  SELECT snap, side, round_even(px / 2.0e0, 0) * 2.0e0 AS price, sum(qty) AS qty, min(px) AS lo, max(px) AS hi
  FROM book GROUP BY ALL HAVING sum(qty) > 0"""
VIEWS["walls"] = """
  SELECT * FROM (SELECT *, avg(qty) OVER s AS mean_qty, count(*) OVER s AS nb FROM clusters WINDOW s AS (PARTITION BY snap, side))
  WHERE nb >= 3 AND qty >= mean_qty * 1.5e0"""
VIEWS["book_sum"] = """
  SELECT *, best_ask - best_bid AS spread, (total_bid - total_ask) / nullif(total_bid + total_ask, 0) AS imbalance FROM (
    SELECT snap, best_bid, best_ask, mid,
           sum(CASE WHEN side = 'bid' AND price >= mid * (1 - 0.005e0) THEN qty ELSE 0 END) AS total_bid,
           sum(CASE WHEN side = 'ask' AND price <= mid * (1 + 0.005e0) THEN qty ELSE 0 END) AS total_ask
    FROM clusters JOIN (SELECT *, (coalesce(best_bid, 0) + coalesce(best_ask, 0)) / 2 AS mid FROM (
      SELECT snap, max(CASE WHEN side = 'bid' THEN px END) AS best_bid, min(CASE WHEN side = 'ask' THEN px END) AS best_ask
      FROM book GROUP BY snap)) USING (snap) GROUP BY ALL)"""


def clusters(v: Views):
    return bk.book_cluster(v.book(), ["snap"], 2.0)


@query("book_cluster", "snap:t side price:f2 qty:f2", "SELECT * FROM clusters")
def _(spark, d):
    return clusters(Views(spark, d))


@query("book_walls", "snap:t side price:f2 qty:f2 mean_qty:f6", "SELECT * FROM walls")
def _(spark, d):
    return bk.book_walls(clusters(Views(spark, d)), ["snap"], 1.5)


@query(
    "book_summary",
    "snap:t best_bid:f4 best_ask:f4 mid:f4 spread:f4 total_bid:f2 total_ask:f2 imbalance:f9",
    "SELECT * FROM book_sum",
)
def _(spark, d):
    return bk.book_summary(clusters(Views(spark, d)), ["snap"])


@query(
    "topk_levels",
    "snap:t side price:f2 qty:f2 rank:i",
    """SELECT *, row_number() OVER (PARTITION BY snap, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rank
       FROM clusters QUALIFY rank <= 40""",
)
def _(spark, d):
    return bk.topk_levels(clusters(Views(spark, d)), ["snap"], 40)


VIEWS["vp_bars"] = """
  SELECT sym, price, sum(v) AS vol FROM (
    SELECT sym, unnest(ps) AS price, volume / len(ps) AS v FROM (
      SELECT sym, volume, list_filter(list_transform(range(0, CAST(floor((high - low + 0.5e0) / 0.5e0) AS BIGINT) + 1),
                     lambda i: round_even((low + i * 0.5e0) / 0.5e0, 0) * 0.5e0),
                     lambda p: p BETWEEN last_close * (1 - 0.5e0) AND last_close * (1 + 0.5e0)) AS ps
      FROM bars JOIN (SELECT sym, last(close ORDER BY ts) AS last_close FROM bars GROUP BY sym) USING (sym)
      WHERE high > low AND volume > 0) WHERE len(ps) > 0) GROUP BY sym, price"""


@query("volume_profile_bars", "sym price:f2 vol:f4", "SELECT * FROM vp_bars")
def _(spark, d):
    return pf.volume_profile_bars(Views(spark, d).bars(), ["sym"], 0.5, 0.5)


def vp_struct(src: str, keys: str, size: str) -> str:
    return f"""
  SELECT *, CASE WHEN last_close > vah THEN 'above_va' WHEN last_close < val THEN 'below_va'
                 WHEN abs(last_close - poc) <= sz * 2 THEN 'at_poc' ELSE 'in_va' END AS position FROM (
    SELECT {keys}, first(price ORDER BY rk) AS poc, max(vol) AS poc_vol,
           max(CASE WHEN in_va THEN price END) AS vah, min(CASE WHEN in_va THEN price END) AS val,
           array_to_string(list(CAST(price AS VARCHAR) ORDER BY rk) FILTER (rk <= 5), ' ') AS hvn,
           array_to_string((list(CAST(price AS VARCHAR) ORDER BY price DESC) FILTER (vol < mean * 0.3e0))[1:3], ' ') AS lvn
    FROM (SELECT *, coalesce(round(cum - 0.70e0 * total, 6) < 0, true) AS in_va FROM (
      SELECT *, row_number() OVER k AS rk, sum(vol) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum,
             sum(vol) OVER p AS total, avg(vol) OVER p AS mean
      FROM (SELECT {keys}, round_even((low + i * sz) / sz, 0) * sz AS price, round(sum(volume / nst), 6) AS vol
            FROM (SELECT *, unnest(range(0, nst)) AS i FROM (
              SELECT *, greatest(CAST(floor((high - low) / sz) AS BIGINT), 1) AS nst FROM (SELECT *, {size} AS sz FROM {src})
              WHERE high > low AND volume > 0)) GROUP BY ALL)
      WINDOW p AS (PARTITION BY {keys}), k AS (PARTITION BY {keys} ORDER BY vol DESC, price)))
    GROUP BY {keys})
  JOIN (SELECT {keys}, last(close ORDER BY ts) AS last_close, any_value({size}) AS sz, count(*) AS bars FROM {src} GROUP BY {keys}) USING ({keys})
  WHERE bars >= 10"""


VIEWS["vp_struct"] = vp_struct("bars", "sym", "0.5e0")
VP_COLS = "poc:f2 poc_vol:f4 vah:f2 val:f2 hvn lvn last_close:f6 position"


def show(df):
    from pyspark.sql import functions as F

    text = lambda c: F.concat_ws(" ", F.col(c).cast("array<string>"))
    return df.withColumns({"hvn": text("hvn"), "lvn": text("lvn")})


@query("volume_profile_struct", f"sym {VP_COLS}", "SELECT * REPLACE (coalesce(lvn, '') AS lvn) FROM vp_struct")
def _(spark, d):
    return show(pf.volume_profile_struct(Views(spark, d).bars(), ["sym"], 0.5))


# Look-back -> (hourly bars, bucket size).
PERIODS = {
    "4h": (4, 0.2), "12h": (12, 0.3), "24h": (24, 0.5), "7d": (168, 0.5), "8d": (192, 0.5), "30d": (720, 0.5), "45d": (1080, 0.5),
}
VIEWS["periods"] = "SELECT b.*, period, size FROM nbars b JOIN (VALUES " + ", ".join(
    f"('{p}', {n}, {s}e0)" for p, (n, s) in PERIODS.items()
) + ") AS p(period, nper, size) ON nn - rn < nper"
VIEWS["vp_periods"] = vp_struct("periods", "sym, period", "size")


@query(
    "volume_profile_periods",
    f"sym period {VP_COLS}",
    "SELECT * REPLACE (coalesce(lvn, '') AS lvn) FROM vp_periods",
)
def _(spark, d):
    rows = pf.period_rows(Views(spark, d).bars(), ["sym"], PERIODS)
    out = pf.volume_profile_struct(rows, ["sym", "period", "size"], "size")
    return show(out)


@query(
    "profile_nearest_bucket",
    "sym price:f2 vol:f4 rank:i poc_bucket:f2",
    """SELECT t.*, n.poc_bucket FROM (
         SELECT *, row_number() OVER (PARTITION BY sym ORDER BY round(vol, 6) DESC, price) AS rank FROM vp_bars QUALIFY rank <= 5) t
       JOIN (SELECT sym, first(price ORDER BY abs(price - poc), -price) AS poc_bucket FROM vp_bars JOIN vp_struct USING (sym) GROUP BY sym) n
       USING (sym)""",
)
def _(spark, d):
    b = Views(spark, d).bars()
    return pf.nearest_bucket(
        pf.volume_profile_bars(b, ["sym"], 0.5, 0.5), pf.volume_profile_struct(b, ["sym"], 0.5), ["sym"]
    )
