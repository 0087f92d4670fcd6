"""Exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import correlation, student_p
from .settle import settle

DIGIT = 16  # bits of a double that one counting pass settles


def ordered_bits(x: Column) -> Column:
    """The 64 bits of a double as an integer that sorts like the double; both zeros are one, NaN is largest."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per name in ``probs``, plus ``n``.

    Radix selection: a pass counts the values of a key by the next DIGIT bits of their ordered form, and each wanted
    order statistic moves into the one digit that holds its rank. Only counts are shuffled, at most 2^DIGIT per key and
    open prefix however many rows a key has; values themselves are never sorted or gathered. An order statistic is found
    when it is the first or the last of its digit, or all values there are equal; four passes settle every double, and
    usually two do. Nulls are left out; a key without values has no row.
    """
    keys, names = list(keys), list(probs)
    x = F.col(value).cast("double")
    rows = settle(df.filter(x.isNotNull()).select(*keys, (x + F.lit(0.0)).alias("__x"), ordered_bits(x).alias("__o")))
    low = F.lit((1 << DIGIT) - 1)
    open_, found = None, []
    for level in range(1, 64 // DIGIT + 1):
        digit = F.shiftright("__o", 64 - DIGIT * level)
        if level == 1:
            own, part, group = rows.withColumn("__p", F.lit(0)), digit, [*keys, "__p"]
        else:
            prefix = F.shiftright("__o", 64 - DIGIT * (level - 1))
            wanted = open_.select(*keys, "__p").distinct()
            own, part, group = rows.withColumn("__p", prefix).join(wanted, [*keys, "__p"]), digit.bitwiseAND(low), [*keys, "__p"]
        counts = own.groupBy(*group, part.alias("__d")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        w = Window.partitionBy(*group).orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)  # 2^DIGIT rows at most
        counts = counts.withColumn("__r", F.sum("__c").over(w))
        if level == 1:
            n = F.sum("__c").over(Window.partitionBy(*keys))
            pos = [(i, (F.col("n") - 1) * F.lit(p)) for i, p in enumerate(probs.values())]
            ranks = F.array(*[
                F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.least(F.floor(at) + 1 + up, F.col("n")).alias("k"))
                for i, at in pos for up in (0, 1)])
            placed = counts.withColumn("n", n).select("*", F.inline(ranks)).filter("k <= __r AND k > __r - __c")
            next_p = F.col("__d")
        else:
            placed = open_.join(counts, [*keys, "__p"]).filter("k <= __r AND k > __r - __c")
            next_p = F.shiftleft("__p", DIGIT).bitwiseOR(F.col("__d"))
        k = F.col("k") - (F.col("__r") - F.col("__c"))
        got = F.when((k == 1) | (F.col("lo") == F.col("hi")), F.col("lo")).when(k == F.col("__c"), F.col("hi"))
        state = settle(placed.select(
            *keys, "n", "i", "up", k.alias("k"), next_p.cast("bigint").alias("__p"), got.alias("v")))
        found.append(state.filter("v IS NOT NULL"))
        open_ = state.filter("v IS NULL").drop("v")
        if open_.isEmpty():
            break
    whole = reduce(DataFrame.union, [f.select(*keys, "n", "i", "up", "v") for f in found])
    rest = [F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("v"))).alias(f"__v{i}_{up}")
            for i in range(len(names)) for up in (0, 1)]

    def value_of(i, p):
        at = (F.col("n") - 1) * F.lit(p)
        a, b, part = F.col(f"__v{i}_0"), F.col(f"__v{i}_1"), at - F.floor(at)
        return F.when(part > 0, a + part * (b - a)).otherwise(a)

    return whole.groupBy(*keys, "n").agg(*rest).select(
        *keys, "n", *[value_of(i, p).alias(name) for i, (name, p) in enumerate(probs.items())])


def value_bin(x: Column) -> Column:
    """A number that never falls as x rises: 256 bins per doubling, mirrored for negative values."""
    size = F.floor(F.log2(F.abs(x)) * 256) + 300_000
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.signum(x).cast("bigint") * size)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Per key and distinct value its rank, ties sharing their mean rank.

    Equal values are counted before the shuffle; ranks run inside narrow value bins and start from the bins' totals.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")).withColumn(
        "__k", value_bin(F.col(value).cast("double"))
    )
    bins = counts.groupBy(*keys, "__k").agg(F.sum("__c").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(*keys, "__k", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__k").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__o") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    return counts.join(starts, [*keys, "__k"]).select(*keys, value, (first + (F.col("__c") + 1) / 2).alias(out))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """Rank correlation per key with its t statistic and two-sided p-value; null below ``min_n`` pairs.

    The pairs are settled first: they are read for the ranks of either side and for the correlation.
    """
    keys = list(keys)
    rows = settle(df.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    ranked = rows.join(average_ranks(rows, keys, x, "__rx"), [*keys, x]).join(
        average_ranks(rows, keys, y, "__ry"), [*keys, y]
    )
    ic = F.col("ic")
    return (
        ranked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), correlation("__rx", "__ry").alias("ic"))
        .withColumn("ic", F.when(F.col("n") >= min_n, ic))
        .withColumn("t_stat", F.when(F.abs(ic) < 1, ic * F.sqrt((F.col("n") - 2) / (1 - ic * ic))))
        .withColumn("p", F.when(F.abs(ic) >= 1, F.lit(0.0)).otherwise(student_p("t_stat", F.col("n") - 2)))
    )
