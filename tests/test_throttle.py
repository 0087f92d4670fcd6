"""The throttle's batch twin against a plain walk, and the work it does where many rows share an hour."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pieces
from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, seq bigint, score int"


def walk(rows, seconds):
    """What is kept of (key, ts, seq, score); a null score is no score before the next row, and no change after a score."""
    out, state = [], {}
    for key, ts, seq, score in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before, at, emitted = state.get(key, (None, None, None))
        new = before is None or (score is not None and score != before) or (ts - at).total_seconds() > seconds
        if new or (ts - emitted).total_seconds() > seconds:
            out.append((key, ts, seq, score))
            emitted = ts
        state[key] = (score, ts, emitted)
    return sorted(out, key=str)


def made(rng, key, n, step, scores):
    t, rows = T0, []
    for i in range(n):
        t += dt.timedelta(microseconds=rng.choice([0, 0, rng.randrange(int(step * 2e6))]))
        rows.append((key, t, i, rng.choice(scores)))
    return rows


@pytest.mark.parametrize("piece_rows", [1 << 18, 50])
def test_throttle_batch_is_the_walk(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(pieces, "PIECE_ROWS", piece_rows)
    rng = random.Random(3)
    rows = made(rng, "steady", 600, 40, [1]) + made(rng, "often", 600, 40, [1, 1, 1, 1, 1, 1, 2]) + made(rng, "rare", 60, 900, [1, 2])
    rows += made(rng, "gaps", 300, 40, [3, 3, 3, 3, None]) + [("one", T0, 1, 5)]
    rows += [("edge", T0 + dt.timedelta(seconds=s), s, 1) for s in (0, 299, 300, 301, 600, 601, 602, 903)]
    got = jobs.throttle_batch(spark.createDataFrame(rows, SCHEMA), ["key"], 300)
    assert sorted((tuple(r) for r in got.collect()), key=str) == walk(rows, 300)


def test_no_frame_over_the_rows_of_a_span(spark, monkeypatch):
    """A sliding frame of time is worked out again for every row: rows of an hour would be paired with each other."""
    plans, write = [], jobs.settle
    monkeypatch.setattr(jobs, "settle", lambda df: (plans.append(df._jdf.queryExecution().toString()), write(df))[1])
    rows = spark.range(2000).select(
        F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").alias("seq"), F.lit(1).alias("score"))
    out = jobs.throttle_batch(rows, ["key"], 300)
    assert sorted(r.seq for r in out.collect()) == list(range(0, 2000, 301))
    assert plans and not any("RangeFrame" in p for p in [*plans, out._jdf.queryExecution().toString()])
