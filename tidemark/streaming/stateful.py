"""Streaming operators with state of their own: each is a processor and the function that applies it.

State is kept by key in the session's RocksDB store, so it may outgrow memory. A processor walks the rows of a key as
they come and holds only what it has to remember.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """These processors need RocksDB as the store of a query's state; the session keeps the setting."""
    spark.conf.set(PROVIDER, ROCKSDB)


# -- throttle


class Throttle(StatefulProcessor):
    """Remembers a key's last emitted score and its time; with ``heartbeat`` a timer repeats it after a silence."""

    def __init__(self, seconds: int, heartbeat: bool):
        self.gap, self.heartbeat = seconds * 1_000_000, heartbeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "score int, us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        score, at = self.last.get() if self.last.exists() else (None, 0)
        before = at if score is not None else None
        # Spark hands over a key's rows of a micro-batch in no order; three numbers of each are put in order
        for us, seq, s in sorted((r.us, r.seq, r.score) for r in rows if r.score is not None):
            while self.heartbeat and score is not None and at + self.gap < us:  # due before this row, timer or not
                at += self.gap
                yield Row(key=key[0], us=at, seq=None, score=score)
            if score is None or s != score or us - at > self.gap:
                score, at = s, us
                yield Row(key=key[0], us=us, seq=seq, score=s)
        if score is not None and at != before:
            self.last.update((score, at))
            if self.heartbeat:
                if before is not None:
                    self.handle.deleteTimer((before + self.gap) // 1000)
                self.handle.registerTimer((at + self.gap) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        score, at = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() != (at + self.gap) // 1000:
            return
        while at + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000:
            at += self.gap
            yield Row(key=key[0], us=at, seq=None, score=score)
        self.last.update((score, at))
        self.handle.registerTimer((at + self.gap) // 1000)

    def close(self) -> None:
        pass


def throttle(rows: DataFrame, key: str, seconds: int, heartbeat: str | None = None) -> DataFrame:
    """(key, ts, seq, score): rows whose score differs from the last emitted one, or that come more than ``seconds`` later.

    Input: ``key``, ts, seq, score, in order of time across micro-batches; a null score is skipped. ``heartbeat`` is a
    watermark delay (such as "10 minutes"): then the last score is also emitted without a new row, with a null ``seq``,
    whenever ``seconds`` have passed in event time since the last emission.
    """
    use_rocksdb(rows.sparkSession)
    src = rows.withWatermark("ts", heartbeat) if heartbeat else rows
    picked = src.select(
        F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint"), F.col("score").cast("int"))
    out = picked.groupBy("key").transformWithState(
        Throttle(seconds, heartbeat is not None), "key string, us bigint, seq bigint, score int", "Append",
        "EventTime" if heartbeat else "None")
    return out.select("key", F.timestamp_micros("us").alias("ts"), "seq", "score")


# -- a bounded history


class History(StatefulProcessor):
    """The newest entries of a key: a list with a time to live, cut to its length whenever something is added."""

    def __init__(self, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "us bigint, entry string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # sorting and cutting as rows come: never more than the kept ones and one chunk of new ones are held
        kept = dict(self.entries.get())
        for r in rows:
            kept[r.us] = r.entry
            if len(kept) > 2 * self.keep:
                kept = dict(sorted(kept.items())[-self.keep :])
        last = sorted(kept.items())[-self.keep :]
        self.entries.put(last)
        for us, entry in last:
            yield Row(key=key[0], us=us, entry=entry, newest=last[-1][0])

    def close(self) -> None:
        pass


def depth_history(summaries: DataFrame, keys: Sequence[str], columns: Sequence[str], keep: int = 48, hours: float = 4) -> DataFrame:
    """The last ``keep`` summaries of every key that got a new one: keys, slot, columns, and ``newest`` (slot of the newest).

    Every update emits the whole history as it then is, so a reader takes the rows of the latest ``newest``. State that no
    update touches is dropped after ``hours``. Of two summaries of one slot the later stays.
    """
    use_rocksdb(summaries.sparkSession)
    row = F.struct(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summaries.select(*keys).schema.fields)
    entry = summaries.select(*columns).schema.simpleString()
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    picked = summaries.select(
        F.to_json(row).alias("key"), F.unix_micros("slot").alias("us"), F.to_json(F.struct(*columns), exact).alias("entry"))
    out = picked.groupBy("key").transformWithState(
        History(keep, int(hours * 3_600_000)), "key string, us bigint, entry string, newest bigint", "Update", "ProcessingTime")
    return out.select(
        F.from_json("key", kinds).alias("k"), F.timestamp_micros("us").alias("slot"), F.from_json("entry", entry, exact).alias("x"),
        F.timestamp_micros("newest").alias("newest")).select("k.*", "slot", "x.*", "newest")


# -- as-of against a stream


class AsOf(StatefulProcessor):
    """Holds left rows until the watermark has passed them, and of the right rows those that can still be asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getMapState("left", "ms bigint", "rows array<struct<us:bigint,body:string>>")
        self.right = handle.getMapState("right", "us bigint", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            if r.side == "right":
                self.right.updateValue((r.us,), (r.body,))
                continue
            ms = r.us // 1000 + 1
            held = self.left.getValue((ms,)) if self.left.containsKey((ms,)) else ([],)
            self.left.updateValue((ms,), ([*held[0], (r.us, r.body)],))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if not self.left.containsKey((ms,)):
            return
        known = sorted(k[0] for k in self.right.keys())
        for us, body in self.left.getValue((ms,))[0]:
            at = [k for k in known if k <= us]
            found = self.right.getValue((at[-1],))[0] if at else None
            yield Row(key=key[0], left=body, right=found)
        self.left.removeKey((ms,))
        # rows that wait or may still come lie after this: of what is before it only the newest can be asked for
        ahead = min((k[0] - 1 for k in self.left.keys()), default=timerValues.getCurrentWatermarkInMs())
        first = min(ahead, timerValues.getCurrentWatermarkInMs()) * 1000
        for k in [k for k in known if k <= first][:-1]:
            self.right.removeKey((k,))

    def close(self) -> None:
        pass


def stream_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], delay: str, slow_delay: str) -> DataFrame:
    """Each row of the stream ``left`` with the ``values`` of the last row of the stream ``right`` at or before its ``ts``.

    A left row comes out once the watermark of both sides has passed it, so a right row that arrives late, within
    ``slow_delay``, is still used; left rows within ``delay`` likewise. Keys must not be null; of two right rows of one key
    and time the later one stays. Left columns that clash with ``values`` are replaced.
    """
    use_rocksdb(left.sparkSession)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    cols = [c for c in left.columns if c not in values]
    key = F.to_json(F.struct(*keys)) if keys else F.lit("all")

    def side(df, name, columns, late):
        return df.withWatermark("ts", late).select(
            key.alias("key"), "ts", F.unix_micros("ts").alias("us"), F.lit(name).alias("side"), F.to_json(F.struct(*columns), exact).alias("body"))

    both = side(left, "left", cols, delay).union(side(right, "right", list(values), slow_delay))
    out = both.groupBy("key").transformWithState(AsOf(), "key string, left string, right string", "Append", "EventTime")
    shape = lambda df, names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)
    return out.select(
        F.from_json("left", shape(left, cols), exact).alias("l"), F.from_json("right", shape(right, values), exact).alias("r")
    ).select("l.*", "r.*")
