"""The cut-up plans must equal plain windows, and nothing may look ahead."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.plans import ordered as od
from tidemark.plans.pieces import piece_of
from tidemark.plans.settle import settle

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    """One key holds most rows; time has gaps."""
    rng, rows = random.Random(7), []
    for sym, n in (("hot", 900), ("a", 40), ("b", 3)):
        t, px = T0, 100.0
        for _ in range(n):
            t += dt.timedelta(hours=rng.choice([1, 1, 1, 2, 50]))
            px *= 1 + rng.gauss(0, 0.01)
            hi, lo = px * (1 + rng.random() / 100), px * (1 - rng.random() / 100)
            vol = 1 + rng.random()
            rows.append((sym, t, px, hi, lo, px, vol, vol * rng.random(), 1000 + 10 * rng.random(), None if rng.random() < 0.2 else 1000 + rng.random()))
    cols = "sym string, ts timestamp, open double, high double, low double, close double, volume double, taker_buy_base double, oi double, oi_fine double"
    return settle(spark.createDataFrame(rows, cols))


def plain_numbered(df, keys, order, slice_seconds=None):
    w = Window.partitionBy(*keys)
    return df.withColumns({"__rn": F.row_number().over(w.orderBy(*order)), "__n": F.count(F.lit(1)).over(w)})


def plain_frames(df, keys, order, add, *, keep_number=False, **_):
    rows = df if "__rn" in df.columns else plain_numbered(df, keys, order)
    out = add(rows, Window.partitionBy(*keys).orderBy(*order))
    return out if keep_number else out.drop("__rn", "__n")


def plain_last(df, keys, order, values, *_):
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()})


def rows_of(df):
    def cell(x):
        return round(x, 7) if isinstance(x, float) else x

    return sorted([tuple(cell(x) for x in r) for r in df.select(*sorted(df.columns)).collect()], key=repr)


def test_row_frames_blocks(spark, bars):
    def add(r, w):
        return r.withColumns(
            {
                "s": F.sum("close").over(w.rowsBetween(-6, 0)), "p": F.lag("close", 3).over(w), "n": F.lead("close", 4).over(w),
                "f": od.full(w, 7, F.min("low").over(w.rowsBetween(-6, 0))),
            }
        )

    got = od.row_frames(bars, ["sym"], ["ts"], add, back=6, ahead=4, slice_seconds=86400 * 5, block_rows=16)
    w = Window.partitionBy("sym").orderBy("ts")
    want = bars.withColumn("__rn", F.row_number().over(w))
    want = add(want, w).drop("__rn")
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize(
    "make",
    [
        lambda b: ind.stochastics(b, ["sym"], (40, 5, 4), (10, 3, 2)),
        lambda b: ind.realized_vol(b, ["sym"], (4, 24, 48)),
        lambda b: ind.rolling_skew(b, ["sym"]),
        lambda b: ind.money_quality(b, ["sym"]),
        lambda b: ind.cut_anchored_mq(b, ["sym"], (24, 3, 2)),
        lambda b: ind.last_rows(b, ["sym"], 5),
        lambda b: ind.vol_percentile(b, ["sym"]),
        lambda b: ind.forward_return(b, ["sym"], [1, 24]),
    ],
)
def test_cut_plan_equals_plain(bars, make, monkeypatch):
    """The same operators on one window per key, as for a series that fits one task."""
    cut_up = rows_of(make(bars))
    for name, plain in (("numbered", plain_numbered), ("row_frames", plain_frames), ("running_last", plain_last)):
        monkeypatch.setattr(ind, name, plain)
    assert rows_of(make(bars)) == cut_up and cut_up


def test_asof_equals_brute_force(spark, bars):
    rng = random.Random(3)
    quotes = [(s, T0 + dt.timedelta(hours=rng.randrange(5000)), float(i)) for i, s in enumerate(["hot"] * 60 + ["b"] * 5)]
    quotes = list({(s, t): (s, t, v) for s, t, v in quotes}.values())
    right = spark.createDataFrame(quotes, "sym string, ts timestamp, q double")
    want = {}
    for r in bars.select("sym", "ts").collect():
        hits = [(t, v) for s, t, v in quotes if s == r.sym and t <= r.ts]
        want[(r.sym, r.ts)] = max(hits)[1] if hits else None
    for seconds in (od.BAR_SLICE, 7 * od.DAY):
        got = od.asof_join(bars.select("sym", "ts"), right, ["sym"], ["q"], slice_seconds=seconds)
        assert {(r.sym, r.ts): r.q for r in got.collect()} == want


def test_grid_asof_equals_brute_force(spark):
    """One key holds nine tenths of the rows; the right side has gaps, and the left runs past both of its ends."""
    rng = random.Random(5)
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    quotes = [(s, T0 + dt.timedelta(hours=h), float(h)) for s in ("hot", "b") for h in sorted(rng.sample(range(200), 60))]
    rows = [("hot" if rng.random() < 0.9 else rng.choice("bc"), minute(rng.randrange(-600, 15000)), i) for i in range(2000)]
    left = spark.createDataFrame(rows, "sym string, ts timestamp, i int")
    right = spark.createDataFrame(quotes, "sym string, ts timestamp, q double")
    got = {r.i: (r.at, r.q) for r in od.grid_asof_join(left, right, ["sym"], ["q"], 3600, right_time_as="at").collect()}
    for s, t, i in rows:
        hits = [(u, v) for k, u, v in quotes if k == s and u <= t]
        assert got[i] == (max(hits) if hits else (None, None))


def test_asof_equal_times_match(spark):
    a = spark.createDataFrame([("x", T0)], "sym string, ts timestamp")
    b = spark.createDataFrame([("x", T0, 1.0)], "sym string, ts timestamp, q double")
    assert od.asof_join(a, b, ["sym"], ["q"]).first().q == 1.0


def test_nearest_join_tolerance_and_ties(spark):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    left = spark.createDataFrame([(m(60),), (m(200),)], "ts timestamp")
    right = spark.createDataFrame([(m(50), 1.0), (m(70), 2.0), (m(230), 3.0), (m(231), 4.0)], "ts timestamp, v double")
    got = {r.ts: r.v for r in od.nearest_join(left, right, [], ["ts"], "v", 1800).collect()}
    assert got == {m(60): 1.0, m(200): 3.0}
    far = od.nearest_join(left, right.filter("v = 4"), [], ["ts"], "v", 1800).collect()
    assert [r.v for r in far] == [None, None]


def test_dedup_is_greedy_across_blocks(spark):
    pos = [1, 5, 9, 20, 21]
    t = spark.createDataFrame([("x", "long", p) for p in pos], "sym string, side string, pos bigint")
    assert sorted(r.pos for r in ind.dedup_triggers(t, ["sym"], 6).collect()) == [1, 9, 20]
    rng = random.Random(1)
    many = sorted(rng.sample(range(3000), 1200))
    t = spark.createDataFrame([("x", "short", p) for p in many], "sym string, side string, pos bigint")
    want, last = [], -(10**9)
    for p in many:
        if p - last >= 7:
            want.append(p)
            last = p
    for block in (8, 64, 4096):
        assert sorted(r.pos for r in ind.dedup_triggers(t, ["sym"], 7, block).collect()) == want


@pytest.mark.parametrize(
    "make",
    [
        lambda b: ind.stochastics(b, ["sym"], (40, 5, 4), (10, 3, 2)),
        lambda b: ind.realized_vol(b, ["sym"], (4, 24, 48)),
        lambda b: ind.vwap_band(b, ["sym"]),
        lambda b: ind.taker_flow(b, ["sym"]),
        lambda b: ind.causal_zscore(b, ["sym"], "close", 20),
        lambda b: ind.money_quality(b, ["sym"]),
        lambda b: ind.cut_anchored_mq(b, ["sym"], (24, 3, 2)),
    ],
)
def test_no_look_ahead(bars, make):
    """Cutting the input off at a time leaves all earlier rows as they were."""
    at = T0 + dt.timedelta(days=60)
    early = bars.filter(F.col("ts") <= F.lit(at))
    assert rows_of(make(early)) == rows_of(make(bars).filter(F.col("ts") <= F.lit(at)))


@pytest.fixture(scope="module")
def crowd(spark):
    """One symbol has nine tenths of the rows, all inside one hour; half of those share one instant."""
    rng, rows = random.Random(11), []
    for i in range(4000):
        hot = rng.random() < 0.9
        at = T0 + (dt.timedelta(microseconds=rng.randrange(3_600_000_000)) if hot else dt.timedelta(hours=rng.randrange(900)))
        rows.append(("hot" if hot else rng.choice("abc"), T0 if hot and rng.random() < 0.5 else at, i, rng.choice([None, float(i)]), rng.randrange(9)))
    return settle(spark.createDataFrame(rows, "sym string, ts timestamp, seq int, v double, w long"))


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr("tidemark.plans.pieces.PIECE_ROWS", 100)


def test_pieces_are_even_and_ordered(crowd, small_pieces):
    by = [F.col("sym"), F.col("ts"), F.col("seq")]
    cut = crowd.withColumn("p", piece_of(crowd, by))
    sizes = [r["count"] for r in cut.groupBy("p").count().collect()]
    assert 30 <= len(sizes) <= 41 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    falls = cut.withColumn("was", F.lag("p").over(Window.orderBy("sym", "ts", "seq"))).filter("p < was").count()
    assert falls == 0
    odd = crowd.withColumns({"sym": F.when(F.col("sym") != "a", F.col("sym")), "v": F.when(F.col("w") > 0, F.col("v"))})
    odd = odd.withColumn("p", piece_of(odd, [F.col("sym"), F.col("v"), F.col("seq")]))  # nulls come first, as Spark sorts
    assert odd.withColumn("was", F.lag("p").over(Window.orderBy("sym", "v", "seq"))).filter("p < was").count() == 0
    assert crowd.filter("false").withColumn("p", piece_of(crowd.filter("false"), by)).count() == 0


def test_prefix_sums_of_a_crowd(crowd, small_pieces):
    got = od.prefix_sums(crowd, ["sym"], ["ts", "seq"], {"before": F.col("w")}, {"all": F.col("w")}, {"next": F.col("v")})
    w = Window.partitionBy("sym").orderBy("ts", "seq")
    want = crowd.withColumns({
        "before": F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all": F.sum("w").over(Window.partitionBy("sym")), "next": F.lead("v").over(w)})
    assert rows_of(got) == rows_of(want)
    assert rows_of(od.numbered(crowd, ["sym"], ["ts", "seq"])) == rows_of(plain_numbered(crowd, ["sym"], ["ts", "seq"]))


def test_running_last_of_a_crowd(crowd, small_pieces):
    got = od.running_last(crowd, ["sym"], ["ts", "seq"], {"x": F.col("v")})
    assert rows_of(got) == rows_of(plain_last(crowd, ["sym"], ["ts", "seq"], {"x": F.col("v")}))


def test_asof_and_nearest_of_a_crowd(spark, crowd, small_pieces):
    quotes = [(s, T0 + dt.timedelta(seconds=120 * i + 1), float(i)) for s in ("hot", "a") for i in range(-2, 40)]
    right = spark.createDataFrame(quotes, "sym string, ts timestamp, q double")
    as_of = {r.seq: r.q for r in od.asof_join(crowd, right, ["sym"], ["q"]).collect()}
    close = {r.seq: r.q for r in od.nearest_join(crowd, right, ["sym"], ["ts", "seq"], "q", 45).collect()}
    rows = crowd.collect()
    assert len(as_of) == len(close) == len(rows)
    for r in rows:
        own = [(t, q) for s, t, q in quotes if s == r.sym]
        past = [x for x in own if x[0] <= r.ts]
        assert as_of[r.seq] == (max(past)[1] if past else None)
        near = sorted((abs(t - r.ts), t, q) for t, q in own if abs(t - r.ts) <= dt.timedelta(seconds=45))
        assert close[r.seq] == (near[0][2] if near else None)


def test_dedup_of_very_many_blocks(spark):
    """A hundred thousand blocks of one key and side, a few of another; the kept ones against a plain walk."""
    rng = random.Random(4)
    hot, at = [], -50
    for _ in range(150_000):
        at += rng.choice([1, 2, 3, 5, 9])
        hot.append(at)
    few = sorted(rng.sample(range(10**6), 30))
    rows = [("hot", "up", p) for p in hot] + [("few", "down", p) for p in few]
    t = spark.createDataFrame(rows, "sym string, side string, pos long")
    got = {}
    for r in ind.dedup_triggers(t, ["sym"], 4, block=5).collect():
        got.setdefault(r.sym, []).append(r.pos)
    for sym, ps in (("hot", hot), ("few", few)):
        want, last = [], -(10**9)
        for p in ps:
            if p - last >= 4:
                want.append(p)
                last = p
        assert sorted(got[sym]) == want
    assert ind.dedup_triggers(t.filter("false"), ["sym"], 4).count() == 0


def test_settle_names_a_shared_folder(spark):
    """On a cluster whose warehouse is a local folder, there is no silent choice."""
    from types import SimpleNamespace

    from tidemark.plans.settle import shared_folder

    def session(master, **conf):
        get = lambda k, default=None: conf.get(k.replace(".", "_"), default)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=get, set=lambda *_: None))

    local = {"spark_sql_warehouse_dir": "file:/tmp/w"}
    assert shared_folder(session("local[8]", **local)) == "file:/tmp/w/_settled"
    assert shared_folder(session("spark://x:1", spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_settled"
    assert shared_folder(session("spark://x:1", spark_checkpoint_dir="file:/shared/", **local)) == "file:/shared"
    for place in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError):
            shared_folder(session("spark://x:1", spark_sql_warehouse_dir=place))
