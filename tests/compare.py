"""Row-set comparison of a Spark result with the same query in DuckDB."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return x
    return x


def _key(row):
    return tuple((x is None, str(type(x)) if x is None else (f"{x:.5g}" if isinstance(x, float) else str(x))) for x in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 + 2e-9 * max(abs(a), abs(b))
    return a == b


def diff(df, con, sql):
    """None when equal, else a short text. Also says how many cells differ in their last digits."""
    cols = sorted(df.columns)
    mine = sorted(([_cell(r[c]) for c in cols] for r in df.collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(([_cell(r[i]) for i in at] for r in cur.fetchall()), key=_key)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    bad = [(m, t) for m, t in zip(mine, theirs) if not all(_same(a, b) for a, b in zip(m, t))]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, e.g. {dict(zip(cols, bad[0][0]))} vs {dict(zip(cols, bad[0][1]))}"
    kinds = [(type(a).__name__, type(b).__name__) for m, t in zip(mine, theirs) for a, b in zip(m, t)
             if a is not None and b is not None and type(a) is not type(b)]
    if kinds:
        return f"types differ {set(kinds)}"
    return None


def inexact(df, con, sql):
    cols = sorted(df.columns)
    mine = sorted(([r[c] for c in cols] for r in df.collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in cols]
    theirs = sorted(([r[i] for i in at] for r in cur.fetchall()), key=_key)
    return sum(1 for m, t in zip(mine, theirs) for a, b in zip(m, t) if repr(a) != repr(b))
