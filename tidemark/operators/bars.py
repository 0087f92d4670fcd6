"""Bars: ticks to OHLCV, coarser bars, returns, and slower series on a bar grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div, log_ratio
from ..plans.ordered import asof_join, row_frames


def start_of(ts: str, seconds: int | Column) -> Column:
    """Start of the bar a time falls in; bars are counted from the epoch."""
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.unix_seconds(ts) - F.pmod(F.unix_seconds(ts), s))


def ticks_to_bars(
    ticks: DataFrame, keys: Sequence[str], seconds: int, extra: Sequence[Column] = ()
) -> DataFrame:
    """OHLCV per key and bar; one shuffle, partially aggregated before it. Empty bars do not appear.

    Time and tie-break are packed into one decimal: a struct would make Spark sort every input split to aggregate it.
    """
    when = F.unix_micros("ts").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("seq")
    return (
        ticks.groupBy(*keys, start_of("ts", seconds).alias("bar"))
        .agg(
            F.min_by("px", when).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", when).alias("close"),
            F.sum("qty").alias("volume"),
            F.sum(F.when(F.col("taker_buy"), F.col("qty")).otherwise(0.0)).alias("taker_buy_base"),
            F.count(F.lit(1)).alias("n"),
            *extra,
        )
        .withColumnRenamed("bar", "ts")
    )


def resample(bars: DataFrame, keys: Sequence[str], seconds: Sequence[int]) -> DataFrame:
    """Coarser bars for several lengths in one pass (``tf_s`` is the length in seconds)."""
    spread = bars.withColumn("tf_s", F.explode(F.array(*[F.lit(s) for s in seconds])))
    return (
        spread.groupBy(*keys, "tf_s", start_of("ts", F.col("tf_s")).alias("bar"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("taker_buy_base").alias("taker_buy_base"),
        )
        .withColumnRenamed("bar", "ts")
    )


def log_returns(bars: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """``ret_h`` = ln(close / close h bars ago), null while there is no such bar."""

    def add(rows, w):
        return rows.withColumns({f"ret_{h}": log_ratio("close", F.lag("close", h).over(w)) for h in horizons})

    return row_frames(bars, keys, ["ts"], add, back=max(horizons))


def taker_imbalance(bars: DataFrame) -> DataFrame:
    """Signed share of aggressive volume and the buy/sell ratio."""
    buy, vol = F.col("taker_buy_base"), F.col("volume")
    return bars.withColumns({"imbalance": div(2 * buy - vol, vol), "taker_ratio": div(buy, vol - buy)})


def hour_grid(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every hour between the first and last bar of a key; days are exploded first so no row grows long."""
    span = bars.groupBy(*keys).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    hour = F.col("d") + F.make_dt_interval(hours=F.col("h"))
    return (
        span.withColumn(
            "d",
            F.explode(
                F.sequence(F.date_trunc("day", "t0"), F.date_trunc("day", "t1"), F.expr("INTERVAL 1 DAY"))
            ),
        )
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .withColumn("ts", hour)
        .filter(F.col("ts").between(F.col("t0"), F.col("t1")))
        .select(*keys, "ts")
    )


def ffill_grid(bars: DataFrame, slow: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bars' close and a slower shared series carried forward on the gapless hour grid."""
    grid = asof_join(hour_grid(bars, keys), bars, keys, ["close"])
    return asof_join(grid, slow, [], [value])


def bars_for_hours(hours: Column, tf_hours: Column) -> Column:
    """Whole bars in a horizon, at least one."""
    return F.greatest(F.lit(1), F.rint(hours / tf_hours).cast("int"))


def with_bars_count(bars: DataFrame, keys: Sequence[str], horizons: Sequence[int], tfs: Sequence[int]) -> DataFrame:
    """Per key, horizon and bar length: the horizon in bars and how many start bars have a full horizon ahead."""
    n = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dims = n.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn(
        "tf", F.explode(F.array(*map(F.lit, tfs)))
    )
    hb = bars_for_hours(F.col("h"), F.col("tf"))
    return dims.select(*keys, "h", "tf", hb.alias("bars"), F.greatest(F.lit(0), F.col("n") - hb).alias("usable"))
