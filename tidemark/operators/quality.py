"""Data-quality expectations. Each returns a table of findings or a repaired column; nothing raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import c, div
from ..plans.settle import settle


def yield_bound(v, max_pct: float) -> Column:
    """A yield above the limit may be quoted times ten; otherwise it is dropped, as are negative ones."""
    v = c(v)
    return F.when(v > max_pct, F.when(v / 10 <= max_pct, v / 10)).when(v >= 0, v)


def crosscheck(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Two sources of one value: where they differ by more than the limit, the second counts."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), list(keys), "left")
    gap = F.when(F.col("b") > 0, F.abs(F.col("a") - F.col("b")) / F.col("b"))
    return both.withColumn("gap", gap).withColumns(
        {
            "value": F.when(F.col("gap") > limit, F.col("b")).otherwise(F.col("a")),
            "source": F.when(F.col("gap") > limit, "second").otherwise("first"),
        }
    )


def latest(series: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(F.max_by(F.struct(*cols), "ts").alias("x")).select(*keys, "x.*")


def duplicate_series(series: DataFrame, part: str, total: str, value: str, limit: float = 0.02) -> DataFrame:
    """Parts whose latest value is within the limit of the total's: the source is repeating the total."""
    now = settle(latest(series, [part], [value]))
    whole = now.filter(F.col(part) == total).agg(F.max(value)).scalar()
    return now.filter(F.col(part) != total).withColumn("total", whole).withColumn(
        "duplicate", F.coalesce(F.abs(div(F.col(value), F.col("total")) - 1) < limit, F.lit(False))
    )


def coverage(series: DataFrame, part: str, total: str, value: str, floor: float = 50.0) -> DataFrame:
    """Sum of the parts' latest values in percent of the total's."""
    now = latest(series, [part], [value])
    is_total = F.col(part) == total
    sums = now.agg(
        F.sum(F.when(~is_total, F.col(value))).alias("tracked"), F.sum(F.when(is_total, F.col(value))).alias("total")
    )
    return sums.withColumn("coverage_pct", div(F.col("tracked") * 100, "total")).withColumn(
        "low", F.col("coverage_pct") < floor
    )


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the data: rows checked and rows breaking each rule (a null breaks it)."""
    bad = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    parts = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("bad")) for n in rules])
    return bad.select("rows", F.inline(parts)).withColumn("ok", F.col("bad") == 0)


def band(name, lo: float, hi: float) -> Column:
    """Strictly inside the band."""
    return (c(name) > lo) & (c(name) < hi)


def distinct_from_total(deltas: DataFrame, part: str, total: str, value: str, pct: str) -> DataFrame:
    """Do parts move on their own? Their percent change must differ from the total's; how many go its way; coverage."""
    now = settle(latest(deltas, [part], [value, pct]))
    is_total = F.col(part) == total
    whole_pct = now.filter(is_total).agg(F.max(pct)).scalar()
    rows = now.withColumn("__p", whole_pct)
    same = F.abs(F.col(pct) - F.col("__p")) < 1e-6
    return rows.agg(
        F.count_if(~is_total).alias("parts"),
        F.count_if(~is_total & (F.coalesce(same, F.lit(True)))).alias("identical"),
        F.count_if(~is_total & ((F.col(pct) > 0) == (F.col("__p") > 0))).alias("same_direction"),
        F.sum(F.when(~is_total, F.col(value))).alias("tracked"),
        F.sum(F.when(is_total, F.col(value))).alias("total"),
    ).withColumn("coverage_pct", div(F.col("tracked") * 100, "total")).withColumn(
        "ok", (F.col("identical") == 0) & F.col("coverage_pct").between(60, 100)
    )


def curve_jumps(basis: DataFrame, keys: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Neighbouring liquid expiries whose annual basis differs by more than the limit; thin curves are skipped."""
    w = Window.partitionBy(*keys).orderBy("dte")  # one row per listed expiry
    rows = basis.filter("basis_ann IS NOT NULL AND dte >= 3 AND oi >= 1000").withColumn(
        "jump", F.abs(F.col("basis_ann") - F.lag("basis_ann").over(w))
    )
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expiries"), F.count_if(F.col("jump") > limit).alias("jumps"), F.max("jump").alias("max_jump")
    ).withColumn("ok", (F.col("expiries") < 3) | (F.col("jumps") == 0))


def parts_equal_total(parts: DataFrame, totals: DataFrame, day: str, limit: float = 2.0) -> DataFrame:
    """Days on which the parts do not add up to the total; days without either are not checked."""
    sums = parts.groupBy(day).agg(F.sum("flow").alias("parts"))
    rows = sums.join(totals.filter("total IS NOT NULL"), day)
    return rows.withColumns({"gap": F.col("parts") - F.col("total"), "ok": F.abs(F.col("parts") - F.col("total")) <= limit})


def enum_and_presence(df: DataFrame, required: Sequence[str], enums: dict[str, Sequence[str]]) -> DataFrame:
    """Required fields present and coded fields within their codes (null allowed there)."""
    rules = {f"has_{f}": F.col(f).isNotNull() for f in required}
    rules |= {f"enum_{f}": F.col(f).isNull() | F.col(f).isin(*codes) for f, codes in enums.items()}
    return report(df, rules)


def freshness(rows: DataFrame, source: str, now: Column, warn_min: float, stale_min: float) -> DataFrame:
    """Age of each source's newest row in minutes, with warning and stale marks."""
    age = (F.unix_micros(now) - F.unix_micros("newest")) / 6e7
    return rows.groupBy(source).agg(F.max("ts").alias("newest")).withColumn("age_min", age).withColumn(
        "status", F.when(F.col("age_min") > stale_min, "stale").when(F.col("age_min") > warn_min, "late").otherwise("ok")
    )

