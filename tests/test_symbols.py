"""Option symbols: their parts, and that a symbol is parsed once and not for every row it was made from."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog import options, sources
from tidemark.operators import options as op
from tidemark.sources.views import Views

CASES = {
    "ETH-29DEC24-3000-C": ("ETH", dt.datetime(2024, 12, 29, 8), 3000.0, True),
    "BTC-1JAN69-0.5-P": ("BTC", dt.datetime(1969, 1, 1, 8), 0.5, False),
    "BTC-29FEB68": ("BTC", dt.datetime(2068, 2, 29, 8), None, None),
    "ETH-29FEB72-7-C\n": ("ETH", dt.datetime(1972, 2, 29, 8), 7.0, True),
}
BAD = ["", None, "ETH", "ETH-31FEB24-1-C", "ETH-29DEC24-1-X", "eth-29DEC24", "ETH-29DEC24-1-C-USDT", "ETH-1XXX24", "ETH-29DEC24-", "-29DEC24", "ETH-29DEC24-1e3-C"]


def test_parts(spark):
    rows = spark.createDataFrame([(s, "kept") for s in [*CASES, *CASES, *BAD]], "instrument string, und string")
    got = op.symbol_parts(rows)
    assert got.columns == ["instrument", "und", "expiry", "strike", "is_call"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((s, *p) for s, p in [*CASES.items()] * 2), key=str)


def below_aggregate(df):
    """The optimized plan from its first aggregate down."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "Aggregate" in plan
    return plan[plan.index("Aggregate") :]


def test_distinct_symbols_are_parsed_after_they_are_made_distinct(spark):
    day = F.date_format(F.timestamp_seconds(F.col("id") % 3 * 86400 + 1_735_430_400), "ddMMMyy")
    made = spark.range(1000).select(F.concat(F.lit("ETH-"), F.upper(day), F.lit("-3000-C")).alias("instrument")).distinct()
    got = op.symbol_parts(made)
    assert got.count() == 3
    assert "regexp_extract" not in below_aggregate(got)


def lineitem(spark, folder, n=400):
    """Two rows of each listing at least; some values missing."""
    i = F.col("id")
    spark.range(2 * n).select(
        (i % n).alias("l_orderkey"), F.when(i % n != 7, i % n % 50).alias("l_partkey"), F.when(i % n != 8, i % n % 3).alias("l_suppkey"),
        F.when(i % n != 9, (i % n % 4).cast("int")).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(0.05).alias("l_discount"),
        F.when(i % n % 5 < 2, "O").when(i % n % 5 < 4, "F").alias("l_linestatus"),
        F.when(i % n != 10, F.timestamp_seconds(F.lit(883_612_800) + i % n % 9 * 86400)).alias("l_shipdate"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    return Views(spark, str(folder))


def test_symbols_of_rows(spark, tmp_path):
    v = lineitem(spark, tmp_path)
    want = set()
    for r in v.table("lineitem").collect():
        if r.l_shipdate is None:
            continue
        name = ("ETH" if r.l_suppkey is not None and r.l_suppkey % 2 == 0 else "BTC") + "-" + f"{r.l_shipdate:%-d%b%y}".upper()
        if r.l_linenumber != 1:
            if r.l_partkey is None:
                continue
            name += f"-{500 + 50 * (r.l_partkey % 41)}-" + ("C" if r.l_linestatus == "O" else "P")
        want.add(name)
    made = options.symbols(v)
    assert sorted(r[0] for r in made.collect() if r[0] is not None) == sorted(want)
    parsed = op.symbol_parts(made)
    assert parsed.count() == len(want)
    assert "regexp_extract" not in below_aggregate(parsed)


def test_union_groups_the_table_once(spark, tmp_path):
    v = lineitem(spark, tmp_path)
    made = sources.unioned(v)
    assert made.count() > 0
    parsed = op.symbol_parts(made)
    assert "lineitem" not in "".join(parsed.inputFiles())  # one settled table of groups serves all listing schemes
    assert parsed.count() == made.filter("instrument IS NOT NULL").count() == v.options().filter("expiry IS NOT NULL AND strike IS NOT NULL").count()
