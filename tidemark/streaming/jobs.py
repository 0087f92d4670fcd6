"""Streaming jobs. Each takes a streaming DataFrame and returns one, or a started query where a sink is part of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import asof_join, row_frames, running_last, top_k
from ..plans.settle import settle
from .stateful import throttle


def tumbling_bars(ticks: DataFrame, keys: Sequence[str], length: str = "1 hour", delay: str = "90 minutes") -> DataFrame:
    """Ticks to bars; a bar comes out once the watermark has passed its end. ``ts`` must be TIMESTAMP, not NTZ."""
    when = F.struct("ts", "seq")
    w = F.window("ts", length)
    src = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    return (
        src.groupBy(*keys, w.alias("w"))
        .agg(
            F.min_by("px", when).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", when).alias("close"), F.sum("qty").alias("volume"),
            F.sum(F.when(F.col("taker_buy"), F.col("qty")).otherwise(0.0)).alias("taker_buy_base"),
        )
        .select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "taker_buy_base")
    )


def sliding_flow(ticks: DataFrame, keys: Sequence[str], length: str, step: str, delay: str = "90 minutes") -> DataFrame:
    """Aggressive flow over a window that moves on by ``step``.

    Ticks are first summed into steps, so a tick is not multiplied by the number of windows it lies in; only the step
    sums are. A chained window keeps the time column usable by the watermark.
    """
    buy = F.when(F.col("taker_buy"), F.col("qty")).otherwise(0.0)
    src = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    steps = src.groupBy(*keys, F.window("ts", step).alias("w")).agg(F.sum(buy).alias("buy"), F.sum("qty").alias("vol"))
    out = steps.groupBy(*keys, F.window(F.window_time("w"), length, step).alias("w2")).agg(
        F.sum("buy").alias("buy"), F.sum(F.col("vol") - F.col("buy")).alias("sell")
    )
    return out.select(
        *keys, F.col("w2.start").alias("start"), F.col("w2.end").alias("end_ts"), "buy", "sell",
        (F.col("buy") - F.col("sell")).alias("delta"), F.when(F.col("sell") > 0, F.col("buy") / F.col("sell")).alias("ratio"),
    )


def depth_summary(snaps: DataFrame, keys: Sequence[str], columns: Sequence[str], every: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """The last snapshot of every five minutes."""
    src = snaps.withWatermark("ts", delay) if snaps.isStreaming else snaps
    return (
        src.groupBy(*keys, F.window("ts", every).alias("w"))
        .agg(F.max_by(F.struct("ts", *columns), F.struct("ts", *columns)).alias("x"))
        .select(*keys, F.col("w.start").alias("slot"), "x.*")
    )


def last_summaries(snaps: DataFrame, keys: Sequence[str], columns: Sequence[str], keep: int = 48, every: str = "5 minutes") -> DataFrame:
    """Batch twin of ``stateful.depth_history``: the newest ``keep`` summaries of every key."""
    return top_k(depth_summary(snaps, keys, columns, every), keys, [F.desc("slot")], keep).drop("rank")


def minute_dedup(rows: DataFrame, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """First arrived row per key and minute; state older than the watermark is dropped."""
    minute = rows.withColumn("minute", F.date_trunc("minute", "ts"))
    return minute.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*keys, "minute"])


def first_per_minute(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Batch twin of ``minute_dedup``: the earliest row per key and minute."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys, F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("x")
    )
    return out.select(*keys, "minute", "x.*")


def throttle_change(rows: DataFrame, key: str, seconds: int = 300, heartbeat: str | None = None) -> DataFrame:
    """Emit a row when its score differs from the last emitted one or more than ``seconds`` have passed since.

    With ``heartbeat``, a watermark delay, a silent key repeats its score after ``seconds`` as well; see ``stateful``.
    """
    return throttle(rows, key, seconds, heartbeat)


def throttle_batch(rows: DataFrame, keys: Sequence[str], seconds: int = 300) -> DataFrame:
    """Batch twin of ``throttle_change`` on any number of rows per key, hour or instant.

    A row whose score differs from its predecessor's is always emitted, and so is one that follows a longer pause. From
    such a head to the next one is a run. Of its other rows only those more than ``seconds`` after the head can be emitted,
    of those of one instant the first. An emitted row's successor is the first such row more than ``seconds`` later, found
    for all in one pass over the run in falling time. Emitted rows are those reached from the heads; doubling the jump
    length finds them in a number of joins that grows with the logarithm of the longest chain. Rows without a time are
    left out.
    """
    keys = list(keys)
    us, gap = F.unix_micros("ts"), seconds * 1_000_000
    base = settle(rows.select(*keys, "ts", "seq", "score", us.alias("us")).filter("ts IS NOT NULL"))

    def add(r, w):
        return r.withColumns({"__s": F.lag("score").over(w), "__t": F.lag("us").over(w)})

    head = F.col("__s").isNull() | (F.col("__s") != F.col("score")) | (F.col("us") - F.col("__t") > gap)
    marked = row_frames(base, keys, ["ts", "seq"], add, back=1, keep_number=True)
    marked = settle(marked.withColumn("head", F.coalesce(head, F.lit(False))).drop("__s", "__t", "__n"))
    start = F.when(F.col("head"), F.struct(F.col("__rn").alias("run"), F.col("us").alias("since")))
    late = settle(running_last(marked, keys, ["__rn"], {"at": start}).filter(F.col("us") - F.col("at.since") > gap).select(
        *keys, "__rn", "ts", "seq", "score", "us", "at.run", "at.since"))
    heads = late.select(*keys, "run", F.col("since").alias("us"), F.col("run").alias("__rn")).distinct()
    firsts = late.groupBy(*keys, "run", "us").agg(F.min("__rn").alias("__rn"))
    # falling time; a row at the very end of a span is not yet more than ``seconds`` later, so the span's end comes first
    ends = heads.unionByName(firsts).select(
        *keys, "run", (-F.col("us") - gap).alias("t"), F.lit(0).alias("side"), F.col("__rn").alias("at"))
    seen = firsts.select(*keys, "run", (-F.col("us")).alias("t"), F.lit(1).alias("side"), F.col("__rn").alias("found"))
    both = settle(ends.unionByName(seen, allowMissingColumns=True))
    hops = running_last(both, [*keys, "run"], ["t", "side"], {"to": F.col("found")}).filter("side = 0 AND to IS NOT NULL")
    kept = reach(heads.select(*keys, F.col("__rn").alias("at")), hops.select(*keys, "at", "to"), keys)
    later = late.join(kept.withColumnRenamed("at", "__rn"), [*keys, "__rn"], "left_semi")
    out = [*keys, "ts", "seq", "score"]
    return marked.filter("head").select(*out).unionByName(later.select(*out))


def reach(start: DataFrame, hops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (``at``) reached from ``start`` over hops (``at`` -> ``to``); each round doubles the jump length."""
    keys = list(keys)
    found, hops = settle(start), settle(hops)
    while not hops.isEmpty():
        step = found.join(hops, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        found = settle(found.unionByName(step).distinct())
        second = hops.select(*keys, F.col("at").alias("to"), F.col("to").alias("far"))
        hops = settle(hops.join(second, [*keys, "to"]).select(*keys, "at", F.col("far").alias("to")))
    return found


def asof_enrich(bars: DataFrame, read_dims, keys: Sequence[str], write):
    """Start a query that joins each micro-batch of bars to the dims as known then; ``read_dims()`` is called per batch.

    ``read_dims`` returns [(frame, values), ...] for ``asof_join``; ``write(df, batch_id)`` stores the result.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(asof_join(batch, read_dims(), keys), batch_id)

    return bars.writeStream.foreachBatch(each)
