"""Domain frames over the given tables: what each table means to the operators.

Column pruning reaches the scans because every view selects only the columns it needs. The SQL twins are in
``catalog/views.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settle import settle

AS_OF = "1998-01-01 00:00:00"
SPOT = 1500.0


class Views:
    """Views over one data folder. ``bars``, ``rets`` and ``states`` are settled: they are read many times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = settle(make())
        return self._kept[name]

    def kept(self, name: str) -> DataFrame:
        """A view settled on first use, for operators that read their input more than once."""
        return self._once(name, getattr(self, name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def ticks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").filter("value > 0").select(  # a trade has a price
            F.col("event_type").alias("sym"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("px"),
            "user_id",
            (F.col("user_id") % 2 == 0).alias("taker_buy"),
            k.alias("k"),
            (k + 1).cast("double").alias("qty"),
        )

    def bars(self) -> DataFrame:
        from ..operators.bars import ticks_to_bars

        extra = [
            (1000 + F.avg("user_id")).alias("oi"),
            (1000 + F.avg(F.when(F.col("k") < 50, F.col("user_id")))).alias("oi_fine"),
        ]
        return self._once("bars", lambda: ticks_to_bars(self.ticks(), ["sym"], 3600, extra))

    def funding(self) -> DataFrame:
        start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 28800) * 28800)
        return (
            self.ticks()
            .groupBy(F.concat(F.lit("v"), F.col("user_id") % 4).alias("venue"), start.alias("ts"))
            .agg(((F.avg("k") - 50) / 1e5).alias("rate"))
        )

    def ls(self) -> DataFrame:
        names = F.array(*[F.lit(v) for v in "boyw"])
        longs = F.col("sym").isin("purchase", "click")
        ratio = (1.0 + F.sum(F.when(longs, F.col("k")).otherwise(0))) / (
            1.0 + F.sum(F.when(longs, 0).otherwise(F.col("k")))
        )
        return (
            self.ticks()
            .groupBy(
                F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("venue"),
                F.date_trunc("hour", "ts").alias("h"),
            )
            .agg(F.max("ts").alias("ts"), ratio.alias("ratio"))
            .select("venue", "ts", "ratio", (F.col("ratio") / (1 + F.col("ratio"))).alias("long_pct"))
        )

    def macro(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(
                F.col("o_orderpriority").alias("label"),
                F.col("o_orderdate").cast("timestamp").alias("ts"),
            )
            .agg(F.avg("o_totalprice").alias("close"))
        )

    def bench(self) -> DataFrame:
        """Daily benchmark closes, stamped when the day is over."""
        day = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
        return (
            self.ticks()
            .filter(F.col("sym").isin("view", "error"))
            .groupBy(day.alias("ts"))
            .agg(
                F.avg(F.when(F.col("sym") == "view", F.col("px"))).alias("btc"),
                F.avg(F.when(F.col("sym") == "error", F.col("px"))).alias("vix"),
            )
        )

    def lineitem(self) -> DataFrame:
        return self.table("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))

    def orders(self) -> DataFrame:
        return self.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))

    def flows(self) -> DataFrame:
        inward = F.col("l_returnflag") != "R"
        li = self.lineitem()
        last = li.agg(F.max("l_shipdate")).scalar()
        signed = F.when(inward, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
        return (
            li.groupBy(
                F.concat(F.lit("a"), F.col("l_suppkey") % 2).alias("asset"),
                F.concat(F.lit("x"), F.col("l_suppkey") % 10).alias("cex"),
                F.col("l_shipdate").alias("ts"),
            )
            .agg(
                F.sum(F.when(inward, F.col("l_quantity")).otherwise(0.0)).alias("inflow"),
                F.sum(F.when(inward, 0.0).otherwise(F.col("l_quantity"))).alias("outflow"),
                F.sum(F.when(inward, F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("net"),
                F.sum(signed).alias("usd"),
                F.count(F.lit(1)).alias("tx"),
            )
            .withColumn("net_usd", F.when(F.col("ts") < last, F.col("usd")))
            .drop("usd")
        )

    def transfers(self) -> DataFrame:
        cust, supp = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
        is_open = F.col("l_linestatus") == "O"
        return self.lineitem().join(self.orders(), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_shipdate").alias("ts"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_orderkey").alias("block"),
            F.when(is_open, cust).otherwise(supp).alias("src"),
            F.when(is_open, supp).otherwise(cust).alias("dst"),
        )

    def tracked(self) -> DataFrame:
        return self.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("address"))

    def owners(self) -> DataFrame:
        own = self.table("customer").filter(F.col("c_custkey") % 7 == 0)
        return self.tracked().union(own.select(F.concat(F.lit("c"), "c_custkey"))).distinct()

    def book(self) -> DataFrame:
        px = 1400 + ((37 * F.col("l_partkey") + 101 * F.col("l_linenumber") + F.col("l_orderkey")) % 801) * 0.25
        return self.lineitem().select(
            F.date_trunc("month", "l_shipdate").alias("snap"),
            px.alias("px"),
            F.when(px < 1500, "bid").otherwise("ask").alias("side"),
            F.col("l_quantity").alias("qty"),
        )

    def options(self) -> DataFrame:
        """One row per listed instrument, as of AS_OF with the spot at SPOT."""
        cents = F.round(100 * F.col("l_discount")).cast("bigint")
        return (
            self.lineitem()
            .filter("l_shipdate >= TIMESTAMP '1998-01-01'")
            .groupBy(
                F.concat(F.lit("u"), F.col("l_suppkey") % 2).alias("und"),
                F.col("l_shipdate").alias("expiry"),
                (500 + 50 * (F.col("l_partkey") % 41)).cast("double").alias("strike"),
                (F.col("l_linestatus") == "O").alias("is_call"),
            )
            .agg(
                F.sum("l_quantity").alias("oi"),
                (30 + 500 * (F.sum(cents) / F.count(F.lit(1)).cast("double")) / 100).alias("iv"),
            )
        )

    def futures(self) -> DataFrame:
        return (
            self.orders()
            .groupBy(
                F.concat(F.lit("u"), F.col("o_custkey") % 2).alias("und"),
                F.date_trunc("month", "o_orderdate").alias("expiry"),
            )
            .agg(
                (1500 * (1 + F.avg("o_totalprice") / 1e8)).alias("mark"),
                (F.count(F.lit(1)) * 100.0).alias("oi"),
                F.sum("o_totalprice").alias("volume"),
            )
        )

    def positions(self) -> DataFrame:
        signed = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
        size = self.orders().groupBy("o_custkey").agg((F.sum(signed) / 1000).alias("szi"))
        key, rich = F.col("c_custkey"), F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10
        step = 10 * (key % 60)
        liq = F.when(F.col("szi") > 0, 2000 - step).otherwise(2000 + step)
        return self.table("customer").join(size, key == F.col("o_custkey"), "left").select(
            F.concat(F.lit("0x"), F.lpad(key.cast("string"), 10, "0")).alias("wallet"),
            "szi",
            F.lit(2000.0).alias("entry_px"),
            F.when(key % 11 != 0, liq).cast("double").alias("liq_px"),
            (1 + key % 25).alias("lev"),
            F.when(key % 2 == 0, "cross").otherwise("isolated").alias("margin_type"),
            F.when(key % 3 == 0, 0.0).otherwise(rich).alias("spot_eth"),
            F.when(key % 3 == 0, rich).otherwise(0.0).alias("mainnet_eth"),
        )

    def reserves(self) -> DataFrame:
        """Token balances per venue and month as a map, the shape balance snapshots come in."""
        status, price = F.col("o_orderstatus"), F.col("o_totalprice")
        pick = lambda s: F.sum(F.when(status == s, price).otherwise(0.0))
        return (
            self.orders()
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(
                F.concat(F.lit("r"), "n_regionkey").alias("venue"),
                F.date_trunc("month", "o_orderdate").alias("ts"),
            )
            .agg(
                F.create_map(
                    F.lit("wETH"), pick("F"), F.lit("usdt"), pick("O"), F.lit("OTHER"), pick("P")
                ).alias("tokens")
            )
        )

    def etf(self) -> DataFrame:
        signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
        return (
            self.lineitem()
            .groupBy(F.col("l_shipdate").alias("day"), F.concat(F.lit("I"), F.col("l_suppkey") % 6).alias("issuer"))
            .agg((F.sum(signed) / 1e6).alias("flow"))
        )

    def etf_total(self) -> DataFrame:
        gap = F.floor(F.unix_seconds("day") / 86400) % 17 == 0
        return self.etf().groupBy("day").agg(F.sum("flow").alias("total")).withColumn(
            "total", F.when(~gap, F.col("total"))
        )

    def state_log(self) -> DataFrame:
        return self.ticks().select(
            "sym", "ts", "seq", F.lit("4h").alias("period"), (F.col("k") % 21 - 10).alias("score"),
            F.col("px").alias("price"),
        )

    def rets(self) -> DataFrame:
        from ..operators.bars import log_returns

        cols = ["sym", "ts", "close", F.col("ret_1").alias("ret")]
        return self._once("rets", lambda: log_returns(self.bars(), ["sym"], [1]).select(*cols))

    def states(self) -> DataFrame:
        from ..operators.regimes import tercile_states

        rets = self.rets().filter(F.col("ret").isNotNull())
        return self._once("states", lambda: tercile_states(rets, ["sym"], "ret"))
