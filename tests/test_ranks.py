import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import log_gamma, student_p
from tidemark.plans import ranks


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    big = np.concatenate([rng.standard_t(2, 20000) / 100, np.zeros(5000), np.full(3000, 0.01)])
    rows = [("big", float(x), float(i % 21)) for i, x in enumerate(big)] + [("few", float(x), float(x)) for x in (3, 1, 2, 10)]
    return spark.createDataFrame(rows, "g string, x double, s double").cache()


def test_exact_quantiles(sample):
    probs = {"a": 0.0, "b": 1 / 3, "c": 0.5, "d": 0.95, "e": 0.99, "f": 1.0}
    got = {r.g: r for r in ranks.exact_quantiles(sample, ["g"], "x", probs).collect()}
    for g in ("big", "few"):
        xs = np.array([r.x for r in sample.filter(F.col("g") == g).collect()])
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-15)


def test_value_bin_never_falls(spark):
    xs = sorted([-1e9, -3.0, -1e-12, 0.0, 1e-300, 1e-12, 0.5, 0.5000001, 1.0, 3.0, 1e9])
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ranks.value_bin(F.col("x")).alias("b")).orderBy("x").collect()
    bins = [r.b for r in rows]
    assert bins == sorted(bins)


def test_spearman(sample):
    rows = sample.filter("g = 'big'").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.s for r in rows])

    def rank(v):
        _, inv, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[inv]

    got = ranks.spearman(sample, ["g"], "x", "s").filter("g = 'big'").first()
    assert got.ic == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-9)
    assert ranks.spearman(sample, ["g"], "x", "s").filter("g = 'few'").first().ic is None


# tabulated two-sided p-values: the t distribution's critical values, and exact ones for 1 and 2 degrees of freedom
TABLE = [(12.706204736432095, 1, 0.05), (4.302652729696142, 2, 0.05), (2.2281388519649385, 10, 0.05), (3.169272672616873, 10, 0.01),
         (1.9839715184496334, 100, 0.05), (2.6258905214380173, 100, 0.01), (0.0, 7, 1.0), (1.0, 1, 0.5), (-1.0, 1, 0.5)]


def test_student_p(spark):
    rows = [(float(t), d, p) for t, d, p in TABLE]
    rows += [(t, 2, 1 - t / (2 + t * t) ** 0.5) for t in (0.01, 0.5, 3.0, 40.0)]  # closed form for two degrees of freedom
    rows += [(t, 4, 1 - (t / (4 + t * t) ** 0.5) * (1 + 2 / (4 + t * t))) for t in (0.2, 1.7, 9.0)]
    df = spark.createDataFrame(rows, "t double, d int, p double")
    for r in df.withColumn("got", student_p("t", "d")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-9), r
    far = spark.createDataFrame([(1.959963984540054, 10**9), (2.5758293035489004, 10**9)], "t double, d long").select(student_p("t", "d").alias("p"))
    assert [r.p for r in far.collect()] == pytest.approx([0.05, 0.01], abs=1e-9)
    assert spark.createDataFrame([(None, 3), (1.0, 0)], "t double, d int").filter(student_p("t", "d").isNotNull()).count() == 0


def test_log_gamma(spark):
    zs = [0.01, 0.5, 1.0, 2.0, 3.7, 10.0, 123.4, 5e8]
    got = [r.g for r in spark.createDataFrame([(z,) for z in zs], "z double").select(log_gamma("z").alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(z) for z in zs], rel=1e-13, abs=1e-11)


def test_quantiles_of_any_doubles(spark):
    """Signs, zeros, infinities and values that differ in their last bit, in one hot key; nulls and NaN as Spark orders them."""
    rng = np.random.default_rng(9)
    xs = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]])
    near = 1.0 + np.arange(500) * 2.0**-52
    rows = [("wild", float(x)) for x in xs] + [("near", float(x)) for x in near] + [("one", 2.5)] * 40 + [("none", None), ("wild", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in ranks.exact_quantiles(df.filter("g IS NOT NULL"), ["g"], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {"wild", "near", "one"} and got["wild"].n == len(xs)
    for g, v in (("wild", np.sort(xs)), ("near", near), ("one", np.full(40, 2.5))):
        assert (got[g].a, got[g].d) == (v[0], v[-1])
        at = (len(v) - 1) * 0.5
        want = v[int(at)] + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - v[int(at)])
        assert got[g].c == want
    nan = spark.createDataFrame([(1, x) for x in (1.0, float("nan"), 2.0)], "g int, x double")
    assert ranks.exact_quantiles(nan, ["g"], "x", {"m": 0.5}).first().m == 2.0
    assert ranks.exact_quantiles(df.filter("false"), ["g"], "x", {"m": 0.5}).count() == 0


def test_quantile_passes_gather_no_values(sample):
    plan = ranks.exact_quantiles(sample, ["g"], "x", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
