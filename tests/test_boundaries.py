"""Small hand-made inputs at the limits of the rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as ex
from tidemark.operators import flows as fw
from tidemark.operators import indicators as ind
from tidemark.operators import options as op
from tidemark.operators import positioning as ps
from tidemark.operators import quality as q
from tidemark.operators import regimes as rg
from tidemark.operators import scoring as sc
from tidemark.sources import payloads as pl

T0 = dt.datetime(2024, 1, 1)


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    "szi, spot, mainnet, label, ratio",
    [
        (-100, 0, 100, "FULLY_HEDGED", 1.0), (-100, 100, 0, "FULLY_HEDGED", 1.0), (-100, 20, 30, "PARTIAL_HEDGE", 0.5),
        (-100, 0, 10, "DIRECTIONAL_BET", 0.1), (-100, 0, 80, "FULLY_HEDGED", 0.8), (-100, 0, 30, "PARTIAL_HEDGE", 0.3),
        (-100, 0, 79.96, "FULLY_HEDGED", 0.8), (100, 0, 30, "DOUBLE_BULL", None), (100, 2, 3, "DIRECTIONAL_BET", None),
        (100, 50, 0, "DOUBLE_BULL", None), (-100, 12, 34, "PARTIAL_HEDGE", 0.46),
    ],
)
def test_hedge_labels(spark, szi, spot, mainnet, label, ratio):
    cols = "wallet string, szi double, entry_px double, liq_px double, lev int, margin_type string, spot_eth double, mainnet_eth double"
    row = one(ps.positions_book(spark.createDataFrame([("0x1234567890", float(szi), 2000.0, None, 5, "cross", float(spot), float(mainnet))], cols), 2000.0))
    assert (row.hedge_label, row.hedge_ratio) == (label, ratio)
    assert row.total_spot_eth == spot + mainnet


def bars(spark, rows):
    cols = "sym string, ts timestamp, open double, high double, low double, close double, volume double, taker_buy_base double"
    data = [("x", T0 + dt.timedelta(hours=i), *r, 1.0, 0.5) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, cols)


def test_flat_bars_are_fifty_and_warm_up_is_null(spark):
    out = ind.stochastics(bars(spark, [(5.0, 5.0, 5.0, 5.0)] * 12), ["sym"], (5, 3, 2), (4, 2, 2)).orderBy("ts").collect()
    assert [r.slow_k for r in out][:6] == [None] * 6 and out[6].slow_k == 50.0
    assert out[6].slow_d is None and out[7].slow_d == 50.0
    short = ind.stochastics(bars(spark, [(5.0, 5.0, 5.0, 5.0)] * 7), ["sym"], (5, 3, 2), (4, 2, 2))
    assert all(r.slow_d is None for r in short.collect())


def test_gamma_flip_fallbacks(spark):
    make = lambda gex: spark.createDataFrame([("u", float(k), float(g)) for k, g in gex], "und string, strike double, gex double")
    flip = lambda gex: one(op.gamma_flip(make(gex), ["und"])).flip
    assert flip([(100, -1), (200, -2)]) == 200
    assert flip([(100, 1), (200, 2)]) == 100
    assert flip([(100, -1), (200, 1), (300, -1), (400, 1)]) == 150  # the lowest crossing
    assert flip([(100, 1), (200, -1)]) is None


def test_skew_without_bracket_needs_a_near_delta(spark):
    def chain(iv):
        rows = [("u", T0 + dt.timedelta(days=30), k, c, 1.0, iv) for k in (1490.0, 1500.0) for c in (True, False)]
        return spark.createDataFrame(rows, "und string, expiry timestamp, strike double, is_call boolean, oi double, iv double")

    r = one(op.option_skew(chain(60.0), ["und"], F.lit(T0), 1500.0))
    assert r.iv_call25 is None and r.iv_put25 is None and r.rr25 is None and r.iv_atm == pytest.approx(0.6)


def test_max_pain_by_hand(spark):
    rows = [("u", T0 + dt.timedelta(days=5), k, c, oi, 50.0) for k, c, oi in [(90.0, True, 10.0), (100.0, False, 5.0), (110.0, False, 20.0), (120.0, True, 1.0)]]
    o = spark.createDataFrame(rows, "und string, expiry timestamp, strike double, is_call boolean, oi double, iv double")
    pay = {t: sum((max(0, t - k) if c else max(0, k - t)) * oi for _, _, k, c, oi, _ in rows) for t in (90, 100, 110, 120)}
    got = one(op.max_pain(o, ["und"], F.lit(T0)))
    assert got.max_pain == min(pay, key=pay.get) and got.pay == min(pay.values())


def test_cdf_against_known_values(spark):
    known = {0.0: 0.5, 1.0: 0.8413447460685429, -1.96: 0.024997895148220435, 3.0: 0.9986501019683699, -8.0: 6.220960574271785e-16}
    rows = spark.createDataFrame([(k,) for k in known], "x double").select("x", ex.norm_cdf("x").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(known[r.x], rel=1e-7, abs=1e-12)


def test_accounting_cells(spark):
    cells = {"(45.6)": -45.6, "-": 0.0, "—": 0.0, "": 0.0, "N/A": 0.0, "1,234.5": 1234.5, "abc": None, "$7": 7.0}
    rows = spark.createDataFrame([(c,) for c in cells], "s string").select("s", ex.accounting_number("s").alias("v")).collect()
    assert {r.s: r.v for r in rows} == cells


def test_html_takes_the_table_with_most_dates(spark):
    page = """<table><tr><th>AAA</th><th>BBB</th><th>CCC</th></tr><tr><td>10 Jan 2025</td><td>1</td><td>2</td></tr></table>
      <TABLE class=x><tr><th>Date</th><th><b>ETHA</b></th><th>FETH</th><th>ETHW</th><th>TOTAL</th></tr>
      <tr><td>10 Jan 2025</td><td>(1.5)</td><td>-</td><td>2&nbsp;</td><td>0.5</td></tr>
      <tr><td>11 Jan 2025</td><td>1</td><td>-</td><td>3</td><td>-</td></tr><tr><td>Total</td><td>1</td><td>1</td><td>1</td></tr></TABLE>"""
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    out = pl.html_tables(pages, ["page_id"]).collect()
    got = {(r.day.day, r.issuer): (r.flow, r.total) for r in out}
    assert got == {
        (10, "ETHA"): (-1.5, 0.5), (10, "FETH"): (0.0, 0.5), (10, "ETHW"): (2.0, 0.5),
        (11, "ETHA"): (1.0, 3.0), (11, "FETH"): (0.0, 3.0), (11, "ETHW"): (3.0, 3.0),
    }


def flows(spark, n, net=100.0):
    rows = [("a", "x", T0 + dt.timedelta(hours=i), net, 0.0, net + i % 2, None, 1) for i in range(n)]
    return spark.createDataFrame(rows, "asset string, cex string, ts timestamp, inflow double, outflow double, net double, net_usd double, tx int")


def test_flow_score_gate_and_floor(spark):
    score = lambda n: one(fw.rolling_flow_z(fw.fill_usd(flows(spark, n), 1.0), ["asset"], 3600))
    few, enough = score(24 + 23), score(24 + 24)
    assert (few.samples, few.z, few.percentile, few.magnitude) == (23, 0.0, 50.0, "NOISE")
    assert enough.samples == 24 and enough.z == pytest.approx((enough.net - enough["mean"]) / 500)


def test_late_bucket_limit(spark):
    late = lambda m: one(fw.late_bucket(flows(spark, 3), ["asset"], 3600, m * 60))
    assert late(89).is_partial and late(89).settled_ts == T0 + dt.timedelta(hours=1)
    assert not late(90).is_partial and late(90).settled_ts == late(90).max_ts
    assert not one(fw.late_bucket(flows(spark, 1), ["asset"], 3600, 0)).is_partial


def test_yield_bound(spark):
    rows = spark.createDataFrame([(4.5,), (45.0,), (450.0,), (-1.0,), (None,)], "v double")
    assert [r.y for r in rows.select(q.yield_bound("v", 20.0).alias("y")).collect()] == [4.5, 4.5, None, None, None]


def test_bucket_halves_go_to_even(spark):
    r = spark.range(1).select(ex.bucket(F.lit(2.5), 1.0).alias("a"), ex.bucket(F.lit(75.0), 50.0).alias("b"), ex.half_up(F.lit(-1.5)).alias("c")).first()
    assert (r.a, r.b, r.c) == (2.0, 100.0, -1)


def test_setup_needs_alignment(spark):
    cols = "slow_k double, slow_d double, fast_k double, fast_d double, fast_k_1 double, fast_k_2 double, cut_direction string, cut_quality string"
    rows = [
        (85.0, 82.0, 90.0, 88.0, 91.0, 92.0, "short", "block"), (85.0, 82.0, 78.0, 84.0, 81.0, 85.0, "short", "upgrade-high"),
        (85.0, 82.0, 70.0, 84.0, 81.0, 85.0, None, None), (15.0, 12.0, 26.0, 12.0, 18.0, 11.0, "short", "block"),
        (50.0, 50.0, 50.0, 50.0, 50.0, 50.0, None, None), (None, 12.0, 26.0, 12.0, 18.0, 11.0, None, None),
    ]
    out = sc.setup_columns(spark.createDataFrame(rows, cols)).collect()
    assert [(r.setup_state, r.setup_dir, r.setup_trigger, r.setup_quality) for r in out] == [
        ("ARMED", "short", None, "BLOCKED"), ("TRIGGERED", "short", "standard", "A++"), ("TRIGGERED", "short", "strict", "A"),
        ("TRIGGERED", "long", "strict", "A"), ("INACTIVE", None, None, None), (None, None, None, None),
    ]


def test_sql_functions(spark):
    ps.register_sql_functions(spark)
    r = spark.sql(
        "SELECT tm_bucket(75D, 50D) b, tm_flow_direction(1.5D, 0D, 0D) f, tm_bs_gamma(100D, 100D, 0.5D, 0.4D, 0D) g, "
        "tm_bs_delta(100D, 100D, 0.5D, 0D, 0.4D, true) d"
    ).first()
    want = spark.range(1).select(
        ex.bs_gamma(F.lit(100.0), F.lit(100.0), F.lit(0.5), F.lit(0.4)).alias("g"),
        ex.bs_delta(F.lit(100.0), F.lit(100.0), F.lit(0.5), F.lit(0.0), F.lit(0.4), F.lit(True)).alias("d"),
    ).first()
    assert (r.b, r.f) == (100.0, "BEARISH") and r.g == pytest.approx(want.g) and r.d == pytest.approx(want.d, abs=1e-9)


def test_hmm_recovers_states(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[0.0, 3.0], [-3.0, 3.0], [3.0, -3.0], [-3.0, -3.0]])
    p = np.full((4, 4), 0.02) + np.eye(4) * 0.92
    s, states = 0, []
    for _ in range(600):
        s = rng.choice(4, p=p[s])
        states.append(s)
    x = centers[states] + rng.normal(0, 0.5, (600, 2))
    rows = [("k", T0 + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(x)]
    f = spark.createDataFrame(rows, "sym string, ts timestamp, log_return double, realized_vol double")
    names = ["log_return", "realized_vol"]
    models = rg.hmm_fit_grid(f, ["sym"], names, [4], [1, 2, 3, 4, 5], min_rows=100)
    best = rg.best_models(models, ["sym"])
    out = rg.hmm_decode(f, best, ["sym"], names).orderBy("ts").collect()
    names_of = {0: "STRESS", 1: "CRASH", 2: "UP", 3: "CHOP"}
    assert np.mean([r.label == names_of[s] for r, s in zip(out, states)]) > 0.98
    now = rg.current_regime(rg.hmm_decode(f, best, ["sym"], names), best, ["sym"], 4).first()
    assert sum(now.forecast_24) == pytest.approx(1.0) and now.dwell > 1


def test_g2_tail(spark):
    # chi-square upper tail, 12 degrees of freedom: 21.026 is the 5% point
    r = spark.range(1).select(rg.chi2_tail(F.lit(21.02606981748307), 12).alias("p")).first()
    assert r.p == pytest.approx(0.05, abs=1e-6)
