"""Bulk scans that turn landed raw payloads into typed rows. Bad cells become null, bad rows are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import accounting_number, looks_like_date, parse_date


def hourly_flows(raw: DataFrame, price: float) -> DataFrame:
    """Rows keyed by '2026-04-04 21:00:00.000 UTC' strings; a missing USD value is the net amount at ``price``."""
    ts = F.try_to_timestamp(F.substring("hour", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    net = num("net_inflow_eth")
    return raw.select(
        F.col("cex_name").alias("cex"), ts.alias("ts"), num("inflow_eth").alias("inflow"),
        num("outflow_eth").alias("outflow"), net.alias("net"),
        F.coalesce(F.col("net_inflow_usd").try_cast("double"), net * price).alias("net_usd"),
        F.coalesce(F.col("tx_count").try_cast("bigint"), F.lit(0)).alias("tx"),
    ).filter("ts IS NOT NULL")


def klines(raw: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Positional bars, ``[[open time, o, h, l, c, vol, close time, quote vol, trades, taker buy, ...], ...]`` as JSON text."""
    rows = raw.select(*keys, F.explode(F.from_json(payload, "array<array<string>>")).alias("k"))
    at = lambda i, t: F.get("k", F.lit(i)).try_cast(t)
    # Position of each field.
    fields = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "taker_buy_base": 9, "taker_buy_quote": 10}
    return rows.select(
        *keys,
        F.timestamp_millis(at(0, "bigint")).alias("ts"),
        F.timestamp_millis(at(6, "bigint")).alias("close_ts"),
        *[at(i, "double").alias(n) for n, i in fields.items()],
        at(8, "bigint").alias("trades"),
    ).filter("ts IS NOT NULL AND close IS NOT NULL")


def series(raw: DataFrame, keys: Sequence[str], ts_field: str, value_fields: Sequence[str], payload: str = "payload") -> DataFrame:
    """Lists of ``{ts, value...}`` objects to ``metric, ts, value`` rows; an object with any bad field is dropped."""
    item = ", ".join(f"`{f}` string" for f in (ts_field, *value_fields))
    rows = raw.select(*keys, F.explode(F.from_json(payload, f"array<struct<{item.replace(' string', ': string')}>>")).alias("d"))
    parts = [F.struct(F.lit(f).alias("metric"), F.col(f"d.{f}").try_cast("double").alias("value")) for f in value_fields]
    rows = rows.withColumns({"ts": F.timestamp_millis(F.col(f"d.{ts_field}").try_cast("bigint")), "v": F.array(*parts)})
    good = F.forall("v", lambda x: x["value"].isNotNull())
    return rows.filter(F.col("ts").isNotNull() & good).select(*keys, "ts", F.inline("v"))


def pair_ratio(raw: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """``{"data": [[ts_ms, ratio], ...]}``: long share = ratio / (1 + ratio); ratios at or below zero are dropped."""
    rows = raw.select(*keys, F.explode(F.from_json(payload, "data array<array<string>>")["data"]).alias("p"))
    r = F.col("ratio")
    return (
        rows.select(
            *keys, F.timestamp_millis(F.get("p", F.lit(0)).try_cast("bigint")).alias("ts"),
            F.get("p", F.lit(1)).try_cast("double").alias("ratio"),
        )
        .filter("ts IS NOT NULL AND ratio > 0")
        .withColumns({"long_pct": r / (1 + r), "short_pct": 1 - r / (1 + r)})
    )


def share_ratio(raw: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """``{"result": {"list": [{buyRatio, sellRatio, timestamp}]}}``: ratio = buy / sell; no sell share, no row."""
    schema = "result struct<list: array<struct<buyRatio: string, sellRatio: string, timestamp: string>>>"
    rows = raw.select(*keys, F.inline(F.from_json(payload, schema)["result"]["list"]))
    return (
        rows.select(
            *keys, F.timestamp_millis(F.col("timestamp").try_cast("bigint")).alias("ts"),
            F.col("buyRatio").try_cast("double").alias("long_pct"), F.col("sellRatio").try_cast("double").alias("short_pct"),
        )
        .filter("ts IS NOT NULL AND long_pct IS NOT NULL AND short_pct > 0")
        .withColumn("ratio", F.col("long_pct") / F.col("short_pct"))
    )


def options_union(full: DataFrame, decimal: DataFrame, split_oi: DataFrame, split_iv: DataFrame) -> DataFrame:
    """Three listing schemes to one: ``instrument oi iv`` with IV in percent.

    ``full``: instrument_name, open_interest, mark_iv (percent). ``decimal``: symbol with a settlement suffix, IV as a
    decimal. ``split_*``: 'ETH-USD-YYMMDD-STRIKE-C' with OI and decimal IV in two lists, joined on the id.
    """
    num = lambda c: F.col(c).try_cast("double")
    a = full.select(F.col("instrument_name").alias("instrument"), num("open_interest").alias("oi"), num("mark_iv").alias("iv"))
    parts = F.split("symbol", "-")
    b = decimal.filter(F.size(parts) >= 4).select(
        F.array_join(F.slice(parts, 1, 4), "-").alias("instrument"), num("openInterest").alias("oi"), (num("markIv") * 100).alias("iv")
    ).filter("oi > 0 AND iv > 0")
    joined = split_oi.select("instId", num("oi").alias("oi")).filter("oi > 0").join(
        split_iv.select("instId", num("markVol").alias("v")).filter("v > 0"), "instId"
    )
    p = F.split("instId", "-")
    day = F.upper(F.date_format(F.try_to_timestamp(F.get(p, F.lit(2)), F.lit("yyMMdd")), "ddMMMyy"))
    d = joined.filter(F.size(p) >= 5).select(
        F.concat_ws("-", F.get(p, F.lit(0)), day, F.get(p, F.lit(3)), F.get(p, F.lit(4))).alias("instrument"),
        "oi", (F.col("v") * 100).alias("iv"),
    )
    return a.unionByName(b).unionByName(d)


def zip_arrays(raw: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], required: str) -> DataFrame:
    """Parallel arrays to rows; a row without time or without the required value is dropped."""
    rows = raw.select(*keys, F.inline(F.arrays_zip(ts, *columns)))
    return rows.filter(F.col(ts).isNotNull() & F.col(required).isNotNull())


def marked_csv(spark, path: str) -> DataFrame:
    """CSV ``date,value`` where '.', '-' and blanks mark missing values."""
    raw = spark.read.csv(path, schema="date string, value string", header=True, mode="PERMISSIVE")
    v = F.trim("value")
    return raw.select(
        F.to_date(F.try_to_timestamp(F.trim("date"), F.lit("yyyy-MM-dd"))).alias("day"),
        F.when(~v.isin("", ".", "-"), v.try_cast("double")).alias("close"),
    ).filter("day IS NOT NULL AND close IS NOT NULL")


def etf_wide(wide: DataFrame) -> DataFrame:
    """``Date, issuers..., Total`` text columns to one row per day and issuer; notes and totals rows are dropped."""
    date, *issuers, total = wide.columns
    text = F.lower(F.trim(date))
    rows = wide.filter((text != "") & ~text.startswith("total") & ~text.contains("seed")).withColumns(
        {"day": parse_date(date), "__total": accounting_number(F.coalesce(total, F.lit("")))}
    )
    long = rows.unpivot(["day", "__total"], issuers, "issuer", "__flow")
    return long.select(
        "day", "issuer", accounting_number(F.coalesce("__flow", F.lit(""))).alias("flow"), F.col("__total").alias("total")
    )


def named(**parts: Column) -> Column:
    """A struct whose field names are set inside a lambda, where aliases are not."""
    return F.named_struct(*[x for n, c in parts.items() for x in (F.lit(n), c)])


# Upper-case words in a header that are no fund.
NOT_TICKERS = ["TOTAL", "DATE", "ETF", "USD"]


def html_tables(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """Fund-flow tables in web pages: one row per page, date row and issuer.

    Per page the table with most date rows is read (the first on a tie); its issuers are the ticker-like cells of the
    row that has most of them, three at least. The total is the right-most number, else the sum of the flows. Each page
    is handled where it lies: no shuffle.
    """
    text = F.regexp_replace(F.col(html), "&nbsp;", " ")
    all_of = lambda s, tag: F.regexp_extract_all(s, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    cell = lambda s: F.trim(F.regexp_replace(s, "<[^>]+>", ""))
    rows_of = lambda t: F.transform(all_of(t, "tr"), lambda r: F.transform(all_of(r, "t[hd]"), cell))
    dated = lambda t: F.filter(t, lambda r: (F.size(r) >= 3) & looks_like_date(F.get(r, F.lit(0))))
    tickers = lambda r: F.filter(r, lambda x: x.rlike("^[A-Z]{3,5}$") & ~x.isin(*NOT_TICKERS))
    pages = pages.filter(F.col(html).contains("<")).select(*keys, F.transform(all_of(text, "table"), rows_of).alias("__t"))
    best = F.array_max(F.transform("__t", lambda t, i: named(n=F.size(dated(t)), o=-i, t=t)))
    pages = pages.filter(F.size("__t") > 0).withColumn("__b", best).filter("__b.n > 0")
    heads = F.filter(
        F.transform("__b.t", lambda r, i: named(n=F.size(tickers(r)), o=-i, c=tickers(r))),
        lambda x: x["n"] >= 3,
    )
    pages = pages.withColumns({"__iss": F.array_max(heads)["c"], "__r": F.explode(dated(F.col("__b.t")))})
    body = F.slice("__r", F.lit(2), F.size("__r"))
    blank = lambda v: v.isin("", "-", "—") | accounting_number(v).isNull()
    numbers = F.transform(F.filter(body, lambda v: ~blank(v)), accounting_number)
    flows = F.transform(
        F.coalesce("__iss", F.array().cast("array<string>")),
        lambda s, j: named(issuer=s, flow=accounting_number(F.coalesce(F.get(body, j), F.lit("")))),
    )
    summed = F.round(F.aggregate(flows, F.lit(0.0), lambda a, x: a + F.coalesce(x["flow"], F.lit(0.0))), 2)
    rows = pages.withColumns(
        {
            "day": parse_date(F.get("__r", F.lit(0))),
            "total": F.coalesce(F.get(F.reverse(numbers), F.lit(0)), F.when(F.size(flows) > 0, summed)),
            "__f": flows,
        }
    )
    return rows.select(*keys, "day", "total", F.inline_outer("__f"))


def inflow_json(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Loosely shaped list of daily inflows in USD; several spellings of each field; totals in millions."""
    v = F.try_parse_json(payload)
    path = lambda x, p, t: F.try_variant_get(x, p, t)
    items = F.coalesce(*[path(v, p, "array<variant>") for p in ("$.data.list", "$.result.list", "$.data", "$.result", "$.list", "$")])
    rows = raw.select(F.explode(items).alias("i"))
    first = lambda *names: F.coalesce(*[path(F.col("i"), f"$.{n}", "string") for n in names])
    return rows.select(
        first("date", "time", "timestamp").alias("date"),
        (first("inflow", "netInflow", "value").try_cast("double") / 1e6).alias("total"),
    ).filter("date IS NOT NULL AND total IS NOT NULL")


def stable_chart(raw: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Supply points whose amount is a number or an object with a peggedUSD number; zero and missing are dropped."""
    v = F.try_parse_json(payload)
    usd = F.coalesce(
        F.try_variant_get(v, "$.totalCirculating.peggedUSD", "double"), F.try_variant_get(v, "$.totalCirculating", "double")
    )
    ts = F.timestamp_seconds(F.try_variant_get(v, "$.date", "bigint"))
    return raw.select(*keys, ts.alias("ts"), usd.alias("usd")).filter("ts IS NOT NULL AND usd <> 0")


WALLET = (
    "perp struct<assetPositions: array<struct<position: struct<coin: string, szi: string, entryPx: string, liquidationPx: string, "
    "leverage: struct<value: int, type: string>, unrealizedPnl: string>>>>, "
    "spot struct<balances: array<struct<coin: string, total: string>>>, mainnetEth double"
)


def wallet_state(raw: DataFrame, coin: str = "ETH", token: str = "UETH", payload: str = "payload") -> DataFrame:
    """Wallet bundles to one row per wallet and open position in ``coin`` (none: one row without it)."""
    b = raw.select("wallet", F.from_json(payload, WALLET).alias("b"))
    amount = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    held = F.aggregate(
        F.coalesce("b.spot.balances", F.array().cast("array<struct<coin:string,total:string>>")),
        F.lit(0.0),
        lambda a, x: F.when(F.upper(x["coin"]) == token, amount(x["total"])).otherwise(a),
    )
    mine = F.filter("b.perp.assetPositions", lambda p: p["position"]["coin"] == coin)
    rows = b.select("wallet", held.alias("spot_eth"), F.coalesce("b.mainnetEth", F.lit(0.0)).alias("mainnet_eth"),
                    F.explode_outer(mine).alias("p"))
    p = lambda f: F.col(f"p.position.{f}")
    return rows.select(
        "wallet", p("szi").try_cast("double").alias("szi"), p("entryPx").try_cast("double").alias("entry_px"),
        p("liquidationPx").try_cast("double").alias("liq_px"), p("leverage.value").alias("lev"),
        F.coalesce(p("leverage.type"), F.when(F.col("p").isNotNull(), "unknown")).alias("margin_type"),
        p("unrealizedPnl").try_cast("double").alias("upnl"), "spot_eth", "mainnet_eth",
    )


def wallet_balances(raw: DataFrame, coins: Sequence[str] = ("UETH", "USDC", "HYPE"), payload: str = "payload") -> DataFrame:
    """Wallet bundles to one row per wallet: the total of each named coin (0 if missing, the last if listed twice) and mainnet ETH."""
    b = raw.select("wallet", F.from_json(payload, WALLET).alias("b"))
    listed = F.coalesce("b.spot.balances", F.array().cast("array<struct<coin:string,total:string>>"))

    def total(coin: str):
        return F.aggregate(listed, F.lit(0.0), lambda a, x: F.when(
            F.upper(x["coin"]) == coin, F.coalesce(x["total"].try_cast("double"), F.lit(0.0))).otherwise(a))

    return b.select("wallet", *[total(c).alias(c.lower()) for c in coins], F.coalesce("b.mainnetEth", F.lit(0.0)).alias("mainnet_eth"))


def asset_contexts(raw: DataFrame, keys: Sequence[str], names: str, contexts: str) -> DataFrame:
    """Two arrays matched by position, names and their contexts; zipped in place, without a join."""
    rows = raw.select(*keys, F.inline(F.arrays_zip(F.col(names).alias("name"), F.col(contexts).alias("ctx"))))
    num = lambda f: F.col(f"ctx.{f}").try_cast("double")
    return rows.select(
        *keys, "name", num("funding").alias("funding"), (num("openInterest") * num("markPx")).alias("oi_usd"),
        num("dayNtlVlm").alias("volume"),
    )


def transfers(raw: DataFrame, decimals: int) -> DataFrame:
    """Raw transfers: integer amounts in the smallest unit, mixed-case addresses, times in seconds."""
    return raw.select(
        F.timestamp_seconds(F.col("timeStamp").try_cast("bigint")).alias("ts"),
        F.lower("from").alias("src"), F.lower(F.coalesce("to", F.lit(""))).alias("dst"),
        (F.col("value").try_cast("decimal(38,0)").cast("double") / 10.0**decimals).alias("value"),
        F.col("blockNumber").try_cast("bigint").alias("block"),
    ).filter("ts IS NOT NULL AND value IS NOT NULL AND block IS NOT NULL")


def state_log(spark, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is kept as ``_corrupt`` with null fields so that it can be counted and left out."""
    return spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def priority(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Per key the first source, in the given order, that has a value; ``source`` is its number.

    An aggregate, not a ranking: each source is reduced before the shuffle.
    """
    tagged = [s.filter(F.col(value).isNotNull()).select(*keys, value, F.lit(i).alias("source")) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.min(F.struct("source", value)).alias("m")).select(*keys, f"m.{value}", "m.source")
