"""Named queries with the SQL that must give the same rows.

``cols`` lists the output as ``name:type``: ``s`` text, ``i`` long, ``t`` timestamp, ``b`` boolean, ``fN`` double shown
with N decimals. Operators keep full precision; rounding happens only here, in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spec(cols: str) -> list[tuple[str, str]]:
    return [tuple((c + ":s").split(":")[:2]) for c in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in _spec(cols):
        col = F.col(name)
        if kind == "i":
            col = col.cast("bigint")
        elif kind == "t":
            col = col.cast("timestamp_ntz")
        elif kind[0] == "f":
            col = F.round(col.cast("double"), int(kind[1:])) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def _shape_sql(body: str, cols: str) -> str:
    out = []
    for name, kind in _spec(cols):
        col = name
        if kind == "i":
            col = f"CAST({name} AS BIGINT)"
        elif kind == "t":
            col = f"CAST({name} AS TIMESTAMP)"
        elif kind[0] == "f":
            col = f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0e0"
        out.append(f"{col} AS {name}")
    return f"SELECT {', '.join(out)} FROM result"


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is a SELECT over the shared views."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return shape(fn(spark, sf_dir), cols)

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, _shape_sql(sql, cols))
        return fn

    return deco
