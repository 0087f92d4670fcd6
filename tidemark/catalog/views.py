"""The shared views as SQL text (see ``sources/views.py`` for the DataFrame side)."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def _uses(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [v for v in VIEWS if v in words]


def with_views(body: str, final: str) -> str:
    """``WITH`` the views the body needs, the body as ``result``, then ``final``."""
    need: set[str] = set()
    todo = _uses(body)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += [u for u in _uses(VIEWS[v]) if u != v]
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need]
    ctes.append(f"result AS ({body})")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


VIEWS["ticks"] = """
  SELECT event_type AS sym, ts, event_id AS seq, value AS px, user_id, user_id % 2 = 0 AS taker_buy,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS qty
  FROM events WHERE value > 0"""

VIEWS["bars"] = """
  SELECT sym, h AS ts, first(px ORDER BY ts, seq) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY ts, seq) AS close, sum(qty) AS volume,
         sum(CASE WHEN taker_buy THEN qty ELSE 0 END) AS taker_buy_base, count(*) AS n,
         1000 + avg(CAST(user_id AS DOUBLE)) AS oi,
         1000 + avg(CASE WHEN k < 50 THEN CAST(user_id AS DOUBLE) END) AS oi_fine
  FROM (SELECT *, date_trunc('hour', ts) AS h FROM ticks) GROUP BY sym, h"""

VIEWS["funding"] = """
  SELECT concat('v', user_id % 4) AS venue,
         make_timestamp(CAST(epoch_us(ts) // 28800000000 AS BIGINT) * 28800000000) AS ts,
         (avg(CAST(k AS DOUBLE)) - 50) / 1e5 AS rate
  FROM ticks GROUP BY ALL"""

VIEWS["ls"] = """
  SELECT venue, ts, ratio, ratio / (1 + ratio) AS long_pct FROM (
    SELECT venue, max(ts) AS ts,
           (1.0e0 + sum(CASE WHEN sym IN ('purchase', 'click') THEN k ELSE 0 END)) /
           (1.0e0 + sum(CASE WHEN sym IN ('purchase', 'click') THEN 0 ELSE k END)) AS ratio
    FROM (SELECT *, ['b', 'o', 'y', 'w'][user_id % 4 + 1] AS venue, date_trunc('hour', ts) AS h FROM ticks)
    GROUP BY venue, h)"""

VIEWS["macro"] = """
  SELECT o_orderpriority AS label, o_orderdate AS ts, avg(o_totalprice) AS close FROM orders GROUP BY ALL"""

VIEWS["bench"] = """
  SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS ts,
         avg(CASE WHEN sym = 'view' THEN px END) AS btc, avg(CASE WHEN sym = 'error' THEN px END) AS vix
  FROM ticks GROUP BY ALL"""

VIEWS["flows"] = """
  SELECT concat('a', l_suppkey % 2) AS asset, concat('x', l_suppkey % 10) AS cex, l_shipdate AS ts,
         sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS inflow,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS outflow,
         sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END) AS net,
         CASE WHEN any_value(l_shipdate) < (SELECT max(l_shipdate) FROM lineitem) THEN
           sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE -l_extendedprice END) END AS net_usd,
         count(*) AS tx
  FROM lineitem GROUP BY 1, 2, 3"""

VIEWS["transfers"] = """
  SELECT l_shipdate AS ts, l_extendedprice AS value, l_orderkey AS block,
         CASE WHEN l_linestatus = 'O' THEN concat('c', o_custkey) ELSE concat('s', l_suppkey) END AS src,
         CASE WHEN l_linestatus = 'O' THEN concat('s', l_suppkey) ELSE concat('c', o_custkey) END AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["tracked"] = "SELECT concat('s', s_suppkey) AS address FROM supplier"

VIEWS["owners"] = """
  SELECT address FROM tracked UNION SELECT concat('c', c_custkey) FROM customer WHERE c_custkey % 7 = 0"""

VIEWS["book"] = """
  SELECT snap, px, CASE WHEN px < 1500 THEN 'bid' ELSE 'ask' END AS side, qty FROM (
    SELECT date_trunc('month', l_shipdate) AS snap, l_quantity AS qty,
           1400 + ((37 * l_partkey + 101 * l_linenumber + l_orderkey) % 801) * 0.25e0 AS px FROM lineitem)"""

VIEWS["options"] = """
  SELECT concat('u', l_suppkey % 2) AS und, l_shipdate AS expiry, CAST(500 + 50 * (l_partkey % 41) AS DOUBLE) AS strike,
         l_linestatus = 'O' AS is_call, sum(l_quantity) AS oi,
         30 + 500 * (sum(CAST(round(100 * l_discount) AS BIGINT)) / CAST(count(*) AS DOUBLE)) / 100 AS iv
  FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1998-01-01'
  GROUP BY ALL"""

VIEWS["futures"] = """
  SELECT concat('u', o_custkey % 2) AS und, date_trunc('month', o_orderdate) AS expiry,
         1500 * (1 + avg(o_totalprice) / 1e8) AS mark, count(*) * 100.0e0 AS oi, sum(o_totalprice) AS volume
  FROM orders GROUP BY ALL"""

VIEWS["positions"] = """
  SELECT concat('0x', lpad(CAST(c_custkey AS VARCHAR), 10, '0')) AS wallet, szi, 2000.0e0 AS entry_px,
         CASE WHEN c_custkey % 11 <> 0 THEN
           CASE WHEN szi > 0 THEN 2000 - 10 * (c_custkey % 60) ELSE 2000 + 10 * (c_custkey % 60) END END AS liq_px,
         1 + c_custkey % 25 AS lev, CASE WHEN c_custkey % 2 = 0 THEN 'cross' ELSE 'isolated' END AS margin_type,
         CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE greatest(c_acctbal, 0) / 10 END AS spot_eth,
         CASE WHEN c_custkey % 3 = 0 THEN greatest(c_acctbal, 0) / 10 ELSE 0 END AS mainnet_eth
  FROM customer LEFT JOIN (
    SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END) / 1000 AS szi
    FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""

VIEWS["reserves"] = """
  SELECT concat('r', n_regionkey) AS venue, date_trunc('month', o_orderdate) AS ts,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS eth,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS usdt,
         sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS other
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""

VIEWS["etf"] = """
  SELECT l_shipdate AS day, concat('I', l_suppkey % 6) AS issuer,
         sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) / 1e6 AS flow
  FROM lineitem GROUP BY ALL"""

VIEWS["etf_total"] = """
  SELECT day, CASE WHEN (epoch_us(day) // 86400000000) % 17 <> 0 THEN sum(flow) END AS total FROM etf GROUP BY day"""

VIEWS["state_log"] = """
  SELECT sym, ts, seq, '4h' AS period, k % 21 - 10 AS score, px AS price FROM ticks"""

VIEWS["rets"] = """
  SELECT sym, ts, close, ln(close / lag(close) OVER (PARTITION BY sym ORDER BY ts)) AS ret FROM bars"""

VIEWS["states"] = """
  SELECT sym, ts, ret, CASE WHEN ret <= lo THEN 0 WHEN ret >= hi THEN 2 ELSE 1 END AS state
  FROM rets JOIN (SELECT sym, quantile_cont(ret, 1.0e0 / 3) AS lo, quantile_cont(ret, 2.0e0 / 3) AS hi
                  FROM rets WHERE ret IS NOT NULL GROUP BY sym) USING (sym)
  WHERE ret IS NOT NULL"""
