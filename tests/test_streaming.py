"""Streaming runs over files must give what the batch twins give on the same files."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources.views import Views
from tidemark.streaming import jobs, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Ticks in time order, six files."""
    path = str(tmp_path_factory.mktemp("ticks"))
    t = Views(spark, SF).ticks()
    for lo in range(1, 31, 5):
        part = t.filter((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < lo + 5))
        part.coalesce(1).sortWithinPartitions("ts", "seq").write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their modification times
    return path, t


def run(spark, landed, make, name):
    path, t = landed
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def closed(df, ts, spark, landed, length, delay):
    """Windows that the watermark of the whole stream has passed."""
    last = landed[1].agg(F.max("ts")).first()[0]
    limit = F.lit(last) - F.expr(f"INTERVAL {delay}")
    return df.filter(F.col(ts) + F.expr(f"INTERVAL {length}") <= limit)


def test_tumbling_bars(spark, landed):
    got = run(spark, landed, lambda s: jobs.tumbling_bars(s, ["sym"]), "bars_out")
    want = jobs.tumbling_bars(landed[1], ["sym"])
    assert rows(got) == rows(closed(want, "ts", spark, landed, "1 hour", "90 minutes"))
    assert got.count() > 50


def test_sliding_flow(spark, landed):
    got = run(spark, landed, lambda s: jobs.sliding_flow(s, ["sym"], "4 hours", "1 hour"), "flow_out")
    want = {tuple(r) for r in jobs.sliding_flow(landed[1], ["sym"], "4 hours", "1 hour").collect()}
    out = {tuple(r) for r in got.collect()}
    assert out and out <= want


def test_depth_summary_and_minute_dedup(spark, landed):
    got = run(spark, landed, lambda s: jobs.depth_summary(s, ["sym"], ["px", "qty"]), "depth_out")
    want = {tuple(r) for r in jobs.depth_summary(landed[1], ["sym"], ["px", "qty"]).collect()}
    assert got.count() > 0 and {tuple(r) for r in got.collect()} <= want
    got = run(spark, landed, lambda s: jobs.minute_dedup(s, ["sym"]), "minute_out")
    want = jobs.first_per_minute(landed[1], ["sym"], ["ts", "seq"])
    assert rows(got.select("sym", "minute", "seq")) == rows(want.select("sym", "minute", "seq"))


def test_throttle(spark, landed):
    coarse = lambda df: df.withColumns({"score": F.floor(F.col("k") / 60).cast("int"), "all": F.lit("x")})
    got = run(spark, landed, lambda s: jobs.throttle_change(coarse(s), "all", 3600), "throttle_out")
    twin = jobs.throttle_batch(coarse(landed[1]), ["all"], 3600)
    want, last_s, last_t = [], None, None
    for r in coarse(landed[1]).orderBy("ts", "seq").collect():
        if last_s is None or r.score != last_s or (r.ts - last_t).total_seconds() > 3600:
            want.append(r.seq)
            last_s, last_t = r.score, r.ts
    assert sorted(r.seq for r in got.collect()) == sorted(want)
    assert sorted(r.seq for r in twin.collect()) == sorted(want)
    assert 10 < len(want) < landed[1].count()


def test_asof_enrich(spark, landed, tmp_path):
    v = Views(spark, SF)
    rate = v.funding().filter("venue = 'v0'")
    out = str(tmp_path / "out")
    path, t = landed
    stream = spark.readStream.schema(t.schema).parquet(path)
    w = jobs.asof_enrich(stream, lambda: [(rate, ["rate"])], [], lambda df, i: df.write.mode("append").parquet(out))
    q = w.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    from tidemark.plans.ordered import asof_join

    want = asof_join(t, rate, [], ["rate"]).select("seq", "rate")
    assert rows(spark.read.parquet(out).select("seq", "rate")) == rows(want)


def feed(spark, path, batches, schema):
    """One file per batch, in order; returns the stream over them."""
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def test_throttle_heartbeat(spark, tmp_path):
    """A silent key repeats its score every five minutes of event time; another key moves the watermark on."""
    batches = [[("a", at(0), 1, 7), ("b", at(0), 2, 1)], [("b", at(12), 3, 1)], [("a", at(13), 4, 8)], [("b", at(40), 5, 1)]]
    stream = feed(spark, str(tmp_path / "in"), batches, "k string, ts timestamp, seq bigint, score int")
    finished(jobs.throttle_change(stream, "k", 300, heartbeat="0 seconds"), "beats")
    got = sorted((r.ts.timestamp(), r.seq is None, r.score) for r in spark.table("beats").filter("key = 'a'").collect())
    times = [int((t - at(0).timestamp()) / 60) for t, _, _ in got]
    assert [(m, s) for m, (_, _, s) in zip(times, got)][:4] == [(0, 7), (5, 7), (10, 7), (13, 8)]
    assert [b for _, b, _ in got][:4] == [False, True, True, False]
    assert times[4:] == [18, 23, 28, 33, 38][: len(times) - 4] and len(times) > 4 and all(s == 8 for _, _, s in got[4:])


def test_history_keeps_48(spark, tmp_path):
    """The 49th summary pushes the first out; a replaced slot counts once."""
    row = lambda i, px: ("x", at(5 * i), at(5 * i + 4), float(px))
    batches = [[row(i, i) for i in range(30)] + [("y", at(0), at(1), 9.0)], [row(29, 100)] + [row(i, i) for i in range(30, 48)], [row(48, 48)]]
    stream = feed(spark, str(tmp_path / "in"), batches, "sym string, slot timestamp, ts timestamp, px double")
    finished(stateful.depth_history(stream, ["sym"], ["ts", "px"]), "kept", "update")
    got = spark.table("kept").filter("sym = 'x'")
    states = {}
    for r in got.collect():
        states.setdefault(r.newest, []).append((r.slot, r.px))
    full, last = (sorted(states[k]) for k in sorted(states)[-2:])
    assert len(full) == len(last) == 48
    assert [px for _, px in full] == [*map(float, range(29)), 100.0, *map(float, range(30, 48))]
    assert [px for _, px in last] == [*map(float, range(1, 29)), 100.0, *map(float, range(30, 49))]
    assert spark.table("kept").filter("sym = 'y'").count() == 1


def test_asof_uses_late_rows(spark, tmp_path):
    """The rate of minute 10 arrives after the bars of minutes 12 and 20, and is the one they get."""
    bars = [[("s", at(5), 1.0), ("t", at(6), 2.0)], [("s", at(12), 3.0), ("s", at(20), 4.0)], [("s", at(61), 5.0)], [("s", at(500), 6.0), ("t", at(500), 7.0)]]
    rates = [[("s", at(0), 0.1)], [("s", at(60), 0.6)], [("s", at(10), 0.2)], [("s", at(499), 0.9), ("t", at(499), 0.5)]]
    left = feed(spark, str(tmp_path / "bars"), bars, "sym string, ts timestamp, close double")
    right = feed(spark, str(tmp_path / "rates"), rates, "sym string, ts timestamp, rate double")
    finished(stateful.stream_asof(left, right, ["sym"], ["rate"], "5 minutes", "2 hours"), "joined")
    got = {(r.sym, r.close): r.rate for r in spark.table("joined").collect()}
    assert {k: v for k, v in got.items() if k[1] < 6} == {
        ("s", 1.0): 0.1, ("t", 2.0): None, ("s", 3.0): 0.2, ("s", 4.0): 0.2, ("s", 5.0): 0.6}


def test_batches_appear_once(spark, landed, tmp_path):
    """A stream whose sink fails after writing replays its batch; a broken attempt and a second driver leave no rows."""
    from tidemark.sources import sinks

    path, t = landed
    out, seen = str(tmp_path / "out"), []

    def write(batch, batch_id):
        sinks.write_batch(batch.select("sym", "ts", "seq", "px"), out, f"q-{batch_id}")
        seen.append(batch_id)
        if seen == [0, 1]:
            raise RuntimeError("lost after the write")

    def go():
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(write).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001  the failure planted above
            assert seen == [0, 1]

    go()
    go()
    assert seen.count(1) == 2 and max(seen) == 5
    spark.range(3).selectExpr("'z' sym", "timestamp'2024-01-01' ts", "-1L seq", "1.0D px", "date'2024-01-01' day", "'half' attempt").write.mode(
        "append").partitionBy("day", "attempt").parquet(f"{out}/rows")
    spark.range(1).selectExpr("'q-0' batch", "'half' attempt", "current_timestamp() at").write.mode("append").parquet(f"{out}/ledger")
    got = sinks.read_batches(spark, out)
    assert rows(got.select("sym", "ts", "seq", "px")) == rows(t.select("sym", "ts", "seq", "px"))
