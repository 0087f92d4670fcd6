"""Volume by price. The group size is the number of price buckets a key spans, not its number of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket, ladder
from ..plans.ordered import numbered, top_k


def last_close(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(F.max_by("close", "ts").alias("last_close"), F.count(F.lit(1)).alias("bars"))


def volume_profile_bars(bars: DataFrame, keys: Sequence[str], size, range_pct: float = 0.10) -> DataFrame:
    """Spread each bar's volume evenly over the price steps it covers near the last close."""
    step = F.lit(size) if isinstance(size, float) else F.col(size)
    rows = bars.join(last_close(bars, keys), list(keys)).filter("high > low AND volume > 0")
    n = F.floor((F.col("high") - F.col("low") + step) / step).cast("int")
    prices = F.transform(F.sequence(F.lit(0), n), lambda i: F.rint((F.col("low") + i * step) / step) * step)
    near = F.filter(prices, lambda p: p.between(F.col("last_close") * (1 - range_pct), F.col("last_close") * (1 + range_pct)))
    return (
        rows.withColumn("__p", near)
        .withColumn("__v", F.col("volume") / F.nullif(F.size("__p"), F.lit(0)))
        .select(*keys, F.explode("__p").alias("price"), "__v")
        .groupBy(*keys, "price")
        .agg(F.sum("__v").alias("vol"))
    )


def volume_levels(bars: DataFrame, keys: Sequence[str], size) -> DataFrame:
    """Volume per price bucket, each bar split over whole steps from its low."""
    step = F.lit(size) if isinstance(size, float) else F.col(size)
    n = F.greatest(F.floor((F.col("high") - F.col("low")) / step).cast("int"), F.lit(1))
    return (
        bars.filter("high > low AND volume > 0")
        .withColumn("__n", n)
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .groupBy(*keys, bucket(F.col("low") + F.col("__i") * step, step).alias("price"))
        .agg(F.round(F.sum(F.col("volume") / F.col("__n")), 6).alias("vol"))
    )


def volume_profile_struct(bars: DataFrame, keys: Sequence[str], size, share: float = 0.70) -> DataFrame:
    """Point of control, value area, high and low volume nodes, and where the last close sits. Needs ten bars.

    Volumes of equal size are ordered by price, so the value area is the same on every run.
    """
    keys = list(keys)
    levels = volume_levels(bars, keys, size)
    w = Window.partitionBy(*keys)
    by_vol = w.orderBy(F.desc("vol"), "price")
    ranked = levels.withColumns(
        {
            "rk": F.row_number().over(by_vol),
            "cum": F.sum("vol").over(by_vol.rowsBetween(Window.unboundedPreceding, -1)),
            "total": F.sum("vol").over(w),
            "mean": F.avg("vol").over(w),
        }
    )
    in_va = F.coalesce(F.round(F.col("cum") - share * F.col("total"), 6) < 0, F.lit(True))
    thin = F.col("vol") < F.col("mean") * 0.3
    high_first = w.orderBy(F.when(thin, 0).otherwise(1), F.desc("price"))
    ranked = ranked.withColumn("__thin", F.when(thin & (F.row_number().over(high_first) <= 3), F.col("price")))
    out = ranked.groupBy(*keys).agg(
        F.min_by("price", "rk").alias("poc"),
        F.max("vol").alias("poc_vol"),
        F.max(F.when(in_va, F.col("price"))).alias("vah"),
        F.min(F.when(in_va, F.col("price"))).alias("val"),
        F.sort_array(F.collect_list(F.when(F.col("rk") <= 5, F.struct("rk", "price"))))["price"].alias("hvn"),
        F.sort_array(F.collect_list("__thin"), asc=False).alias("lvn"),
    )
    step = F.lit(size) if isinstance(size, float) else F.col(size)
    c = F.col("last_close")
    return (
        out.join(last_close(bars, keys), keys)
        .filter("bars >= 10")
        .withColumn(
            "position",
            ladder(
                (c > F.col("vah"), "above_va"), (c < F.col("val"), "below_va"),
                (F.abs(c - F.col("poc")) <= step * 2, "at_poc"), otherwise="in_va",
            ),
        )
    )


def period_rows(bars: DataFrame, keys: Sequence[str], periods: dict[str, tuple[int, float]]) -> DataFrame:
    """Each bar once per look-back period it belongs to; ``size`` is that period's bucket."""
    rows = numbered(bars, keys, ["ts"])
    age = F.col("__n") - F.col("__rn")
    part = [
        F.when(age < n, F.struct(F.lit(name).alias("period"), F.lit(size).alias("size")))
        for name, (n, size) in periods.items()
    ]
    return rows.select(*bars.columns, F.inline(F.array_compact(F.array(*part))))


def nearest_bucket(levels: DataFrame, shape: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k heaviest levels of a profile, and the level nearest to the point of control."""
    poc = shape.select(*keys, "poc")
    near = (
        levels.join(poc, list(keys))
        .groupBy(*keys)
        .agg(F.min_by("price", F.struct(F.abs(F.col("price") - F.col("poc")), -F.col("price"))).alias("poc_bucket"))
    )
    top = top_k(levels, keys, [F.desc(F.round("vol", 6)), F.col("price")], k)
    return top.join(near, list(keys))
