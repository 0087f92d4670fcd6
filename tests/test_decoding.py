"""Decoding in blocks equals decoding the whole series at once."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import decoding

T0 = dt.datetime(2024, 1, 1)
NAMES = ["log_return", "realized_vol"]
MODEL_ROW = (
    "sym string, start array<double>, trans array<array<double>>, means array<array<double>>, vars array<array<double>>, "
    "feature_mean array<double>, feature_std array<double>"
)


def whole(x, pi, a, mu, var):
    """Most likely path and posteriors, bar after bar, all in logarithms."""
    logb, la, lpi = decoding.emit(x, mu, var), np.log(a), np.log(np.asarray(pi) + 1e-300)
    f, v, back = [lpi + logb[0]], [lpi + logb[0]], []
    for b in logb[1:]:
        f.append(np.logaddexp.reduce(f[-1][:, None] + la, axis=0) + b)
        back.append((v[-1][:, None] + la).argmax(0))
        v.append((v[-1][:, None] + la).max(0) + b)
    be = [np.zeros(len(la))]
    for b in logb[:0:-1]:
        be.insert(0, np.logaddexp.reduce(la + b + be[0], axis=1))
    path = [int(v[-1].argmax())]
    for step in back[::-1]:
        path.insert(0, int(step[path[0]]))
    post = np.array(f) + np.array(be)
    post = np.exp(post - post.max(1, keepdims=True))
    return path, post / post.sum(1, keepdims=True)


def series(seed, n, k, apart):
    """A model of ``k`` states and features drawn from it; ``apart`` spreads the means."""
    rng = np.random.default_rng(seed)
    a = 0.8 * np.eye(k) + 0.2 * rng.dirichlet(np.ones(k), k)
    mu, var = rng.normal(0, apart, (k, 2)), rng.uniform(0.05, 1.5, (k, 2))
    states = rng.integers(0, k, n)
    pi = np.zeros(k)
    pi[0] = 1.0  # starts that cannot be are allowed
    return rng.normal(mu[states], np.sqrt(var[states])), pi, a, mu, var


KEYS = {"one": (1, 1, 4, 1.0), "few": (2, 5, 4, 1.0), "edge": (3, 16, 3, 0.3), "long": (4, 403, 4, 0.5), "sharp": (5, 150, 4, 60.0)}


@pytest.fixture(scope="module")
def made(spark):
    truth, rows, models = {}, [], []
    for sym, how in KEYS.items():
        x, pi, a, mu, var = series(*how)
        truth[sym] = whole(x, pi, a, mu, var)
        mean, std = np.array([2.0, -1.0]), np.array([3.0, 0.5])
        rows += [(sym, T0 + dt.timedelta(hours=i), *map(float, r * std + mean)) for i, r in enumerate(x)]
        models.append((sym, pi.tolist(), a.tolist(), mu.tolist(), var.tolist(), mean.tolist(), std.tolist()))
    rows.append(("no model", T0, 0.0, 0.0))
    models.append(("no bars", *models[0][1:]))
    f = spark.createDataFrame(rows, "sym string, ts timestamp, log_return double, realized_vol double").repartition(5)
    return truth, f, spark.createDataFrame(models, MODEL_ROW)


@pytest.mark.parametrize("block, fan", [(512, 64), (4, 2), (3, 5)])
def test_blocks_equal_the_whole(made, block, fan):
    truth, f, models = made
    got = {}
    for r in decoding.hmm_decode(f, models, ["sym"], NAMES, block=block, fan=fan).collect():
        got.setdefault(r.sym, []).append(r)
    assert set(got) == set(truth)
    for sym, (path, post) in truth.items():
        rows = sorted(got[sym], key=lambda r: r.ts)
        assert [r.state for r in rows] == path
        np.testing.assert_allclose([r.posterior for r in rows], post, atol=1e-9)
        assert [r.smoothed for r in rows] == post.argmax(1).tolist()
        np.testing.assert_allclose([r.confidence for r in rows], post.max(1), atol=1e-9)


def test_newest_bars_and_no_bars(made):
    truth, f, models = made
    out = decoding.hmm_decode(f, models, ["sym"], NAMES, bars=10, block=4, fan=2).groupBy("sym").count().collect()
    assert {r.sym: r["count"] for r in out} == {s: min(10, len(p)) for s, (p, _) in truth.items()}
    assert decoding.hmm_decode(f.filter("false"), models, ["sym"], NAMES).count() == 0
    assert decoding.hmm_decode(f, models.filter("false"), ["sym"], NAMES).count() == 0
