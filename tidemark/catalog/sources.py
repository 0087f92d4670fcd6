from pyspark.sql import functions as F

from ..functions.exprs import parse_date
from ..operators import flows as fw
from ..operators import options as opt
from ..operators import quality as q
from ..plans.settle import application_folder
from ..sources import payloads as pl
from ..sources.views import Views
from .flows import deltas, supply
from .options import skew
from .positioning import basis, book
from .registry import query
from .views import VIEWS


def scratch(spark, name: str) -> str:
    import uuid

    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ms(col="ts"):
    return F.unix_millis(col).cast("string")


def text(col):
    return F.col(col).cast("string")


@query(
    "src_klines",
    "sym ts:t close_ts:t open:f6 high:f6 low:f6 close:f6 volume:f2 taker_buy_base:f2 trades:i",
    "SELECT *, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_ts, n AS trades FROM bars",
)
def _(spark, d):
    b = Views(spark, d).bars()
    zero = F.lit("0")
    k = F.array(
        ms(), text("open"), text("high"), text("low"), text("close"), text("volume"), (F.unix_millis("ts") + 3_599_999).cast("string"),
        zero, text("n"), text("taker_buy_base"), zero,
    )
    raw = b.groupBy("sym", F.to_date("ts").alias("page")).agg(F.to_json(F.collect_list(k)).alias("payload"))  # 24 bars a page
    return pl.klines(raw, ["sym"])


@query(
    "src_series",
    "sym ts:t metric value:f6",
    """SELECT sym, ts, metric, CASE WHEN metric = 'sumOpenInterest' THEN oi ELSE oi * close END AS value
       FROM bars, (VALUES ('sumOpenInterest'), ('sumOpenInterestValue')) AS m(metric) WHERE n <> 13""",
)
def _(spark, d):
    b = Views(spark, d).bars()
    item = F.struct(
        ms().alias("timestamp"), F.when(F.col("n") == 13, "bad").otherwise(text("oi")).alias("sumOpenInterest"),
        (F.col("oi") * F.col("close")).cast("string").alias("sumOpenInterestValue"),
    )
    raw = b.groupBy("sym", F.to_date("ts").alias("page")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return pl.series(raw, ["sym"], "timestamp", ["sumOpenInterest", "sumOpenInterestValue"])


LS = "venue ts:t ratio:f9 long_pct:f9 short_pct:f9"


def ls_page(v: Views, venue: str, item, wrap):
    rows = v.ls().filter(F.col("venue") == venue)
    return rows.groupBy("venue", F.to_date("ts").alias("page")).agg(F.to_json(wrap(F.collect_list(item))).alias("payload"))


@query("src_pair_ratio", LS, "SELECT *, 1 - long_pct AS short_pct FROM (SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM ls WHERE venue = 'o')")
def _(spark, d):
    raw = ls_page(Views(spark, d), "o", F.array(ms(), text("ratio")), lambda x: F.struct(x.alias("data")))
    return pl.pair_ratio(raw, ["venue"])


@query(
    "src_share_ratio",
    LS,
    "SELECT venue, ts, long_pct / (1 - long_pct) AS ratio, long_pct, 1 - long_pct AS short_pct FROM (SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM ls WHERE venue = 'y')",
)
def _(spark, d):
    item = F.struct(text("long_pct").alias("buyRatio"), (1 - F.col("long_pct")).cast("string").alias("sellRatio"), ms().alias("timestamp"))
    raw = ls_page(Views(spark, d), "y", item, lambda x: F.struct(F.struct(x.alias("list")).alias("result")))
    return pl.share_ratio(raw, ["venue"])


INST = """concat(CASE WHEN und = 'u0' THEN 'ETH-' ELSE 'BTC-' END, upper(strftime(expiry, '%d%b%y')), '-', CAST(CAST(strike AS BIGINT) AS VARCHAR), '-', CASE WHEN is_call THEN 'C' ELSE 'P' END)"""


def unioned(v: Views):
    o = v.kept("options").withColumn("coin", F.when(F.col("und") == "u0", "ETH").otherwise("BTC"))
    cp = F.when(F.col("is_call"), "C").otherwise("P")
    k = F.col("strike").cast("bigint").cast("string")
    day = F.upper(F.date_format("expiry", "ddMMMyy"))
    part = lambda m: o.filter((F.col("strike") / 50) % 3 == m)
    a = part(0).select(F.concat_ws("-", "coin", day, k, cp).alias("instrument_name"), text("oi").alias("open_interest"), text("iv").alias("mark_iv"))
    b = part(1).select(
        F.concat_ws("-", "coin", day, k, cp, F.lit("USDT")).alias("symbol"), text("oi").alias("openInterest"),
        (F.col("iv") / 100).cast("string").alias("markIv"),
    )
    inst = F.concat_ws("-", F.concat("coin", F.lit("-USD")), F.date_format("expiry", "yyMMdd"), k, cp).alias("instId")
    c = part(2)
    oi = c.select(inst, text("oi").alias("oi"))
    iv = c.select(inst, (F.col("iv") / 100).cast("string").alias("markVol"))
    return pl.options_union(a, b, oi, iv)


@query("src_options_union", "instrument oi:f2 iv:f6", f"SELECT {INST} AS instrument, oi, iv FROM options")
def _(spark, d):
    return unioned(Views(spark, d))


@query(
    "union_venues",
    "und expiry:t strike:f2 is_call n:i oi:f2",
    "SELECT CASE WHEN und = 'u0' THEN 'ETH' ELSE 'BTC' END AS und, expiry + INTERVAL 8 HOUR AS expiry, strike, is_call, count(*) AS n, sum(oi) AS oi FROM options GROUP BY ALL",
)
def _(spark, d):
    parsed = opt.symbol_parts(unioned(Views(spark, d)))
    return parsed.groupBy("und", "expiry", "strike", "is_call").agg(F.count(F.lit(1)).alias("n"), F.sum("oi").alias("oi"))


@query(
    "src_zip_arrays",
    "label ts:t close:f6 volume:i",
    """SELECT o_orderpriority AS label, o_orderdate AS ts, avg(o_totalprice) AS close, count(*) AS volume FROM orders GROUP BY ALL HAVING count(*) % 5 <> 0""",
)
def _(spark, d):
    o = Views(spark, d).orders()
    daily = o.groupBy(F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume")
    ).withColumn("close", F.when(F.col("volume") % 5 != 0, F.col("close")))
    items = F.sort_array(F.collect_list(F.struct("ts", "close", "volume")))
    raw = daily.groupBy("label", F.year("ts").alias("page")).agg(items.alias("x")).select(
        "label", F.col("x.ts").alias("ts"), F.col("x.close").alias("close"), F.col("x.volume").alias("volume")
    )
    return pl.zip_arrays(raw, ["label"], "ts", ["close", "volume"], "close")


@query(
    "src_marked_csv",
    "day:t close:f6",
    """SELECT o_orderdate AS day, avg(o_totalprice) AS close FROM orders GROUP BY o_orderdate HAVING count(*) % 4 <> 0""",
)
def _(spark, d):
    daily = Views(spark, d).orders().groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    mark = F.element_at(F.array(F.lit("."), F.lit("-"), F.lit("")), (F.col("n") % 3 + 1).cast("int"))
    out = daily.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("n") % 4 == 0, mark).otherwise(text("v")).alias("value")
    )
    path = scratch(spark, "csv")
    out.write.csv(path, header=True, emptyValue="", nullValue="")
    return pl.marked_csv(spark, path)


ISSUERS = [f"I{i}" for i in range(6)]
VIEWS["etf_long"] = """
  SELECT d.day, i.issuer, coalesce(e.flow, 0) AS flow, coalesce(t.total, 0) AS total
  FROM (SELECT * FROM (SELECT DISTINCT day FROM etf) d, (SELECT DISTINCT issuer FROM etf) i) AS g(day, issuer)
  JOIN (SELECT day FROM etf GROUP BY day) d ON d.day = g.day JOIN (SELECT DISTINCT issuer FROM etf) i ON i.issuer = g.issuer
  LEFT JOIN etf e ON e.day = g.day AND e.issuer = g.issuer LEFT JOIN etf_total t ON t.day = g.day"""


def money_text(x):
    """A number as the source prints it: brackets for negatives, a dash for nothing."""
    return F.when(x.isNull(), "-").when(x < 0, F.concat(F.lit("("), F.abs(x).cast("decimal(20,8)").cast("string"), F.lit(")"))).otherwise(
        x.cast("decimal(20,8)").cast("string")
    )


def wide_days(v: Views):
    e = v.etf()
    return e.groupBy("day").pivot("issuer", ISSUERS).agg(F.sum("flow")).join(v.etf_total(), "day")


@query("src_etf_wide", "day:t issuer flow:f9 total:f9", "SELECT * FROM etf_long")
def _(spark, d):
    w = wide_days(Views(spark, d)).select(
        F.date_format("day", "d MMM yyyy").alias("Date"), *[money_text(F.col(i)).alias(i) for i in ISSUERS], money_text(F.col("total")).alias("Total")
    )
    path = scratch(spark, "etf")
    w.write.csv(path, header=True)
    return pl.etf_wide(spark.read.csv(path, header=True))


TICK = ["IAX", "IBX", "ICX", "IDX", "IEX", "IFX"]


@query(
    "src_html_tables",
    "page_id:i day:t issuer flow:f9 total:f9",
    """SELECT -(year(day) * 100 + month(day)) AS page_id, day, ['IAX', 'IBX', 'ICX', 'IDX', 'IEX', 'IFX'][CAST(substr(issuer, 2) AS INT) + 1] AS issuer, flow,
              coalesce((SELECT t.total FROM etf_total t WHERE t.day = e.day), round(sum(flow) OVER (PARTITION BY day), 2)) AS total
       FROM etf_long e""",
)
def _(spark, d):
    v = Views(spark, d)
    td = lambda x: F.concat(F.lit("<td class='n'>"), x, F.lit("</td>"))
    days = wide_days(v)
    row = F.concat(
        F.lit("<tr>"), td(F.date_format("day", "dd MMM yyyy")), *[td(money_text(F.col(i))) for i in ISSUERS],
        td(F.when(F.col("total").isNull(), "").otherwise(money_text(F.col("total")))), F.lit("</tr>"),
    )
    # a missing total leaves only dashes to the right of the flows: print the sum there, as a page would
    total_gap = F.concat(F.lit("<tr>"), td(F.date_format("day", "dd MMM yyyy")), *[td(money_text(F.col(i))) for i in ISSUERS],
                         td(F.round(sum(F.coalesce(F.col(i), F.lit(0.0)) for i in ISSUERS), 2).cast("decimal(20,2)").cast("string")), F.lit("</tr>"))
    row = F.when(F.col("total").isNull(), total_gap).otherwise(row)
    head = "<tr><th>Date</th>" + "".join(f"<th><b>{t}</b></th>" for t in TICK) + "<th>TOTAL</th></tr>"
    month = (F.year("day") * 100 + F.month("day")).alias("m")
    made = days.groupBy(month).agg(F.array_join(F.collect_list(row), "\n").alias("rows")).select(
        (-F.col("m")).cast("bigint").alias("page_id"),
        F.concat(F.lit(f"<html><table><tr><td>menu</td></tr></table><table>{head}"), "rows", F.lit("</table></html>")).alias("html"),
    )
    return pl.html_tables(v.table("pages").select("page_id", "html").unionByName(made), ["page_id"])


@query(
    "src_inflow_json",
    "date total:f9",
    "SELECT strftime(day, '%Y-%m-%d') AS date, total * 1e6 / 1e6 AS total FROM etf_total WHERE total IS NOT NULL",
)
def _(spark, d):
    t = Views(spark, d).etf_total()
    usd = (F.col("total") * 1e6).cast("string")
    odd = F.dayofmonth("day") % 2 == 1
    item = F.struct(
        F.when(odd, F.date_format("day", "yyyy-MM-dd")).alias("date"), F.when(~odd, F.date_format("day", "yyyy-MM-dd")).alias("time"),
        F.when(odd, usd).alias("inflow"), F.when(~odd, usd).alias("netInflow"),
    )
    page = t.groupBy(F.year("day").alias("y"), F.month("day").alias("m")).agg(F.collect_list(item).alias("list"))
    in_data = F.to_json(F.struct(F.struct("list").alias("data")))
    bare = F.to_json(F.struct(F.col("list").alias("result")))
    return pl.inflow_json(page.select(F.when(F.col("m") % 2 == 0, in_data).otherwise(bare).alias("payload")))


@query("src_stable_chart", "venue ts:t usd:f2", "SELECT venue, ts, usdt AS usd FROM reserves WHERE usdt <> 0")
def _(spark, d):
    b = fw.token_map(Views(spark, d).reserves())
    date = F.unix_seconds("ts").alias("date")
    as_obj = F.to_json(F.struct(date, F.struct(F.col("stable").alias("peggedUSD")).alias("totalCirculating")))
    as_num = F.to_json(F.struct(date, F.col("stable").alias("totalCirculating")))
    raw = b.select("venue", F.when(F.month("ts") % 2 == 0, as_obj).otherwise(as_num).alias("payload"))
    return pl.stable_chart(raw, ["venue"])


@query(
    "src_wallet_state",
    "wallet szi:f6 entry_px:f2 liq_px:f2 lev:i margin_type spot_eth:f6 mainnet_eth:f6",
    """SELECT wallet, szi, CASE WHEN szi IS NOT NULL THEN entry_px END AS entry_px, liq_px * (szi * 0 + 1) AS liq_px, CASE WHEN szi IS NOT NULL THEN lev END AS lev,
              CASE WHEN szi IS NOT NULL THEN margin_type END AS margin_type, spot_eth, mainnet_eth FROM positions""",
)
def _(spark, d):
    return pl.wallet_state(bundles(Views(spark, d).positions()))


@query(
    "src_wallet_balances",
    "wallet ueth:f6 usdc:f2 hype:f2 mainnet_eth:f6",
    "SELECT wallet, spot_eth AS ueth, 10 AS usdc, 0 AS hype, mainnet_eth FROM positions",
)
def _(spark, d):
    return pl.wallet_balances(bundles(Views(spark, d).positions()))


def bundles(p):
    """Positions as raw wallet payloads."""
    position = F.struct(
        F.lit("ETH").alias("coin"), text("szi").alias("szi"), text("entry_px").alias("entryPx"), text("liq_px").alias("liquidationPx"),
        F.struct(F.col("lev").alias("value"), F.col("margin_type").alias("type")).alias("leverage"), F.lit("0").alias("unrealizedPnl"),
    )
    other = F.struct(
        F.lit("BTC").alias("coin"), F.lit("1").alias("szi"), F.lit("60000").alias("entryPx"), F.lit("55000").alias("liquidationPx"),
        F.struct(F.lit(5).cast("bigint").alias("value"), F.lit("cross").alias("type")).alias("leverage"), F.lit("0").alias("unrealizedPnl"),
    )
    wrap = lambda x: F.struct(x.alias("position"))
    held = F.when(F.col("szi").isNotNull(), F.array(wrap(other), wrap(position))).otherwise(F.array(wrap(other)))
    bundle = F.struct(
        F.struct(held.alias("assetPositions")).alias("perp"),
        F.struct(
            F.array(
                F.struct(F.lit("USDC").alias("coin"), F.lit("10").alias("total")),
                F.struct(F.lit("ueth").alias("coin"), text("spot_eth").alias("total")),
            ).alias("balances")
        ).alias("spot"),
        F.col("mainnet_eth").alias("mainnetEth"),
    )
    return p.select("wallet", F.to_json(bundle).alias("payload"))


VIEWS["ctx"] = """
  SELECT date_trunc('hour', ts) AS ts, sym AS name, avg(CAST(k AS DOUBLE)) / 1e5 AS funding, sum(qty) * max(px) AS oi_usd, sum(px) AS volume FROM ticks GROUP BY ALL"""


@query("src_asset_ctx", "ts:t name funding:f9 oi_usd:f4 volume:f4", "SELECT * FROM ctx")
def _(spark, d):
    return contexts(Views(spark, d))


@query("join_position_pairs", "ts:t name oi_usd:f4", "SELECT ts, name, oi_usd FROM ctx")
def _(spark, d):
    return contexts(Views(spark, d)).select("ts", "name", "oi_usd")


def contexts(v: Views):
    t = v.ticks().groupBy(F.date_trunc("hour", "ts").alias("ts"), "sym").agg(
        (F.avg("k") / 1e5).alias("f"), F.sum("qty").alias("oi"), F.max("px").alias("mark"), F.sum("px").alias("vol")
    )
    ctx = F.struct(
        text("f").alias("funding"), text("oi").alias("openInterest"), text("mark").alias("markPx"), text("vol").alias("dayNtlVlm")
    )
    raw = t.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("sym", ctx.alias("c")))).alias("x")).select(
        "ts", F.col("x.sym").alias("names"), F.col("x.c").alias("ctxs")
    )
    return pl.asset_contexts(raw, ["ts"], "names", "ctxs")


@query("src_transfers", "ts:t src dst value:f2 block:i", "SELECT * FROM transfers")
def _(spark, d):
    t = Views(spark, d).transfers()
    wei = F.concat(F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit("0000"))
    raw = t.select(
        F.unix_seconds("ts").cast("string").alias("timeStamp"), F.upper("src").alias("from"), F.upper("dst").alias("to"),
        wei.alias("value"), text("block").alias("blockNumber"),
    )
    return pl.transfers(raw, 6)


@query(
    "src_state_log",
    "ok n:i score:i price:f2",
    "SELECT seq % 13 <> 0 AS ok, count(*) AS n, sum(CASE WHEN seq % 13 <> 0 THEN score END) AS score, sum(CASE WHEN seq % 13 <> 0 THEN price END) AS price FROM state_log GROUP BY 1",
)
def _(spark, d):
    log = Views(spark, d).state_log()
    line = F.to_json(F.struct(F.unix_millis("ts").alias("timestamp"), "period", "score", "price", F.struct("sym").alias("stoch")))
    broken = F.expr("substring(line, 1, length(line) - 5)")
    out = log.withColumn("line", line).select(F.when(F.col("seq") % 13 == 0, broken).otherwise(F.col("line")).alias("value"))
    path = scratch(spark, "log")
    out.write.text(path)
    rows = pl.state_log(spark, path, "timestamp bigint, period string, score int, price double, stoch struct<sym: string>")
    ok = F.col("_corrupt").isNull()
    return rows.groupBy(ok.alias("ok")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(ok, F.col("score"))).alias("score"), F.sum(F.when(ok, F.col("price"))).alias("price")
    )


@query(
    "src_priority",
    "label ts:t close:f6 source:i",
    """SELECT label, ts, coalesce(a.close, b.close) AS close, CASE WHEN a.close IS NOT NULL THEN 0 ELSE 1 END AS source
       FROM (SELECT * FROM macro WHERE day(ts) % 2 = 1) a FULL JOIN (SELECT label, ts, close * 2 AS close FROM macro WHERE day(ts) % 3 <> 0) b USING (label, ts)""",
)
def _(spark, d):
    m = Views(spark, d).macro()
    day = F.dayofmonth("ts")
    first = m.filter(day % 2 == 1)
    second = m.filter(day % 3 != 0).withColumn("close", F.col("close") * 2)
    return pl.priority([first, second], ["label", "ts"], "close")


@query(
    "date_formats",
    "raw day:t",
    """SELECT raw, day FROM (SELECT DISTINCT o_orderdate AS day FROM orders), LATERAL (SELECT unnest([strftime(day, '%Y-%m-%d'), strftime(day, '%-d %b %Y'), strftime(day, '%-d %B %Y'), strftime(day, '%d/%m/%Y')]) AS raw)
       UNION SELECT 'no date', NULL""",
)
def _(spark, d):
    days = Views(spark, d).orders().select("o_orderdate").distinct()
    fmt = lambda f: F.date_format("o_orderdate", f)
    raw = days.select(F.explode(F.array(fmt("yyyy-MM-dd"), fmt("d MMM yyyy"), fmt("d MMMM yyyy"), fmt("dd/MM/yyyy"), F.lit("no date"))).alias("raw"))
    return raw.distinct().withColumn("day", parse_date("raw").cast("timestamp"))


# -- quality -------------------------------------------------------------------------------------------------------


@query(
    "q_yield_bound",
    "label ts:t raw:f9 pct:f9",
    "SELECT label, ts, raw, CASE WHEN raw > 20 THEN CASE WHEN raw / 10 <= 20 THEN raw / 10 END WHEN raw >= 0 THEN raw END AS pct FROM (SELECT *, close / 1000 - 50 AS raw FROM macro)",
)
def _(spark, d):
    m = Views(spark, d).macro().withColumn("raw", F.col("close") / 1000 - 50)
    return m.withColumn("pct", q.yield_bound("raw", 20.0))


VIEWS["xc"] = """
  SELECT a.label, a.ts, a.close AS a, b.close AS b, CASE WHEN b.close > 0 THEN abs(a.close - b.close) / b.close END AS gap FROM macro a
  LEFT JOIN (SELECT o_orderpriority AS label, o_orderdate AS ts, max(o_totalprice) AS close FROM orders GROUP BY ALL) b USING (label, ts)"""


@query(
    "q_crosscheck",
    "label ts:t a:f6 b:f6 gap:f6 value:f6 source",
    "SELECT *, CASE WHEN gap > 0.5 THEN b ELSE a END AS value, CASE WHEN gap > 0.5 THEN 'second' ELSE 'first' END AS source FROM xc",
)
def _(spark, d):
    v = Views(spark, d)
    b = v.orders().groupBy(F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("value"))
    return q.crosscheck(v.macro().withColumnRenamed("close", "value"), b, ["label", "ts"])


VIEWS["sup_now"] = "SELECT * FROM stab QUALIFY row_number() OVER (PARTITION BY coin ORDER BY ts DESC) = 1"


@query(
    "q_duplicate_series",
    "coin usd:f2 total:f2 duplicate",
    "SELECT coin, usd, total, coalesce(abs(usd / nullif(total, 0) - 1) < 0.02, false) AS duplicate FROM sup_now, (SELECT usd AS total FROM sup_now WHERE coin = 'ALL') WHERE coin <> 'ALL'",
)
def _(spark, d):
    return q.duplicate_series(supply(Views(spark, d)), "coin", "ALL", "usd")


@query(
    "q_coverage",
    "tracked:f2 total:f2 coverage_pct:f6 low",
    "SELECT *, tracked * 100 / nullif(total, 0) AS coverage_pct, tracked * 100 / nullif(total, 0) < 50 AS low FROM (SELECT sum(usd) FILTER (coin <> 'ALL') AS tracked, sum(usd) FILTER (coin = 'ALL') AS total FROM sup_now)",
)
def _(spark, d):
    return q.coverage(supply(Views(spark, d)), "coin", "ALL", "usd")


@query(
    "q_distinct_from_total",
    "parts:i identical:i same_direction:i tracked:f2 total:f2 coverage_pct:f6 ok",
    """SELECT *, tracked * 100 / nullif(total, 0) AS coverage_pct, identical = 0 AND tracked * 100 / nullif(total, 0) BETWEEN 60 AND 100 AS ok FROM (
         SELECT count_if(coin <> 'ALL') AS parts, count_if(coin <> 'ALL' AND coalesce(abs(pct_7 - p) < 1e-6, true)) AS identical,
                count_if(coin <> 'ALL' AND ((pct_7 > 0) = (p > 0))) AS same_direction, sum(usd) FILTER (coin <> 'ALL') AS tracked, sum(usd) FILTER (coin = 'ALL') AS total
         FROM sup_now, (SELECT pct_7 AS p FROM sup_now WHERE coin = 'ALL'))""",
)
def _(spark, d):
    return q.distinct_from_total(deltas(Views(spark, d)), "coin", "ALL", "usd", "pct_7")


def _rule(name, cond):
    return f"SELECT '{name}' AS rule, count(*) AS rows, count_if(NOT coalesce({cond}, false)) AS bad, count_if(NOT coalesce({cond}, false)) = 0 AS ok FROM "


@query(
    "q_band",
    "rule rows:i bad:i ok",
    " UNION ALL ".join(
        _rule(n, c) + "skew"
        for n, c in (("rr25", "rr25 > -0.15 AND rr25 < 0.15"), ("iv_atm", "iv_atm > 0.10 AND iv_atm < 2.0"), ("dte", "dte > 0 AND dte < 400"))
    ),
)
def _(spark, d):
    return q.report(
        skew(Views(spark, d)), {"rr25": q.band("rr25", -0.15, 0.15), "iv_atm": q.band("iv_atm", 0.10, 2.0), "dte": q.band("dte", 0, 400)}
    )


@query(
    "q_curve_jumps",
    "und expiries:i jumps:i max_jump:f6 ok",
    """SELECT und, count(*) AS expiries, count_if(jump > 0.01) AS jumps, max(jump) AS max_jump, count(*) < 3 OR count_if(jump > 0.01) = 0 AS ok FROM (
         SELECT *, abs(basis_ann - lag(basis_ann) OVER (PARTITION BY und ORDER BY dte)) AS jump FROM fut_b WHERE dte >= 3 AND oi >= 1000) GROUP BY und""",
)
def _(spark, d):
    return q.curve_jumps(basis(Views(spark, d)), ["und"], 0.01)


@query(
    "q_parts_equal_total",
    "day:t parts:f9 total:f9 gap:f6 ok",
    "SELECT *, parts - total AS gap, abs(parts - total) <= 2 AS ok FROM (SELECT day, sum(flow) AS parts FROM etf GROUP BY day) JOIN etf_total USING (day) WHERE total IS NOT NULL",
)
def _(spark, d):
    v = Views(spark, d)
    return q.parts_equal_total(v.etf(), v.etf_total(), "day")


NEED = ["mainnet_eth", "total_spot_eth", "spot_eth", "hedge_label", "side", "size_eth", "liq_px"]
CODES = ["FULLY_HEDGED", "PARTIAL_HEDGE", "DIRECTIONAL_BET", "DOUBLE_BULL"]


@query(
    "q_enum_and_presence",
    "rule rows:i bad:i ok",
    " UNION ALL ".join(
        [_rule(f"has_{f}", f"{f} IS NOT NULL") + "pos" for f in NEED]
        + [_rule("enum_hedge_label", "hedge_label IS NULL OR hedge_label IN ('FULLY_HEDGED', 'PARTIAL_HEDGE', 'DIRECTIONAL_BET', 'DOUBLE_BULL')") + "pos"]
    ),
)
def _(spark, d):
    return q.enum_and_presence(book(Views(spark, d)), NEED, {"hedge_label": CODES})


@query(
    "q_freshness",
    "sym newest:t age_min:f6 status",
    """SELECT *, CASE WHEN age_min > 75 THEN 'stale' WHEN age_min > 30 THEN 'late' ELSE 'ok' END AS status FROM (
         SELECT sym, max(ts) AS newest, (epoch_us(TIMESTAMP '2024-01-31 00:30:00') - epoch_us(max(ts))) / 6e7 AS age_min FROM ticks GROUP BY sym)""",
)
def _(spark, d):
    now = F.lit("2024-01-31 00:30:00").cast("timestamp")
    return q.freshness(Views(spark, d).ticks(), "sym", now, 30, 75)
