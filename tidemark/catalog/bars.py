from ..operators import bars as op
from ..sources.views import Views
from .registry import query

HOUR = 3600


@query(
    "bars_resample",
    "sym tf_s:i ts:t open:f6 high:f6 low:f6 close:f6 volume:f2 taker_buy_base:f2",
    """SELECT sym, tf_s, bar AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
              last(close ORDER BY ts) AS close, sum(volume) AS volume, sum(taker_buy_base) AS taker_buy_base
       FROM (SELECT bars.*, tf_s,
                    make_timestamp(CAST(epoch_us(ts) // (tf_s * 1000000) AS BIGINT) * (tf_s * 1000000)) AS bar
             FROM bars, (VALUES (14400::BIGINT), (43200), (86400)) AS d(tf_s))
       GROUP BY sym, tf_s, bar""",
)
def _(spark, d):
    return op.resample(Views(spark, d).bars(), ["sym"], [4 * HOUR, 12 * HOUR, 24 * HOUR])


@query(
    "bars_logret",
    "sym ts:t close:f6 ret_1:f9 ret_4:f9 ret_24:f9",
    """SELECT sym, ts, close, ln(close / lag(close, 1) OVER w) AS ret_1, ln(close / lag(close, 4) OVER w) AS ret_4,
              ln(close / lag(close, 24) OVER w) AS ret_24
       FROM bars WINDOW w AS (PARTITION BY sym ORDER BY ts)""",
)
def _(spark, d):
    return op.log_returns(Views(spark, d).bars(), ["sym"], [1, 4, 24])


@query(
    "bars_taker_imbalance",
    "sym ts:t volume:f2 imbalance:f9 taker_ratio:f9",
    """SELECT sym, ts, volume, (2 * taker_buy_base - volume) / volume AS imbalance,
              taker_buy_base / nullif(volume - taker_buy_base, 0) AS taker_ratio FROM bars""",
)
def _(spark, d):
    return op.taker_imbalance(Views(spark, d).bars())


@query(
    "bars_ffill_grid",
    "sym ts:t close:f6 rate:f9",
    """SELECT g.sym, g.ts, b.close, f.rate
       FROM (SELECT sym, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY sym) g
       ASOF LEFT JOIN bars b ON g.sym = b.sym AND g.ts >= b.ts
       ASOF LEFT JOIN (SELECT * FROM funding WHERE venue = 'v0') f ON g.ts >= f.ts""",
)
def _(spark, d):
    v = Views(spark, d)
    return op.ffill_grid(v.bars(), v.funding().filter("venue = 'v0'"), ["sym"], "rate")


@query(
    "bars_for_horizon",
    "sym h:i tf:i bars:i usable:i",
    """SELECT sym, h, tf, greatest(1, round_even(h / CAST(tf AS DOUBLE), 0)) AS bars,
              greatest(0, n - greatest(1, round_even(h / CAST(tf AS DOUBLE), 0))) AS usable
       FROM (SELECT sym, count(*) AS n FROM bars GROUP BY sym),
            (VALUES (4), (12), (24), (48)) AS a(h), (VALUES (1), (4), (12), (24)) AS b(tf)""",
)
def _(spark, d):
    return op.with_bars_count(Views(spark, d).bars(), ["sym"], [4, 12, 24, 48], [1, 4, 12, 24])
