"""Writers. Appends add files, never rewrite; readers merge the schemas of all files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_snapshot(df: DataFrame, depth: int = 2, sep: str = "_") -> DataFrame:
    """Nested columns to flat ones down to ``depth`` levels; arrays, maps and deeper parts become JSON text.

    Booleans become 0/1. The column list comes from the schema, so this is one projection.
    """
    out = []

    def walk(path: str, name: str, kind: T.DataType, level: int) -> None:
        col = F.col(path)
        if isinstance(kind, T.BooleanType):
            out.append(col.cast("int").alias(name))
        elif isinstance(kind, T.StructType) and level < depth:
            for f in kind.fields:
                walk(f"{path}.`{f.name}`", f"{name}{sep}{f.name}", f.dataType, level + 1)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(col).alias(name))
        else:
            out.append(col.alias(name))

    for f in df.schema.fields:
        walk(f"`{f.name}`", f.name, f.dataType, 0)
    return df.select(*out)


def write_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append as zstd parquet, one folder per UTC day. Rows are spread by day and hour, so a busy day has many writers."""
    day = F.to_date(ts)
    (
        df.withColumn("day", day)
        .repartition(F.col("day"), F.hour(ts))
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("day")
        .parquet(path)
    )


def read_daily(spark, path: str) -> DataFrame:
    """All days with the union of their columns; a column a file lacks reads as typed nulls."""
    return spark.read.option("mergeSchema", "true").parquet(path)


LEDGER = "batch string, attempt string, at timestamp"


def _ledger(spark, path: str) -> DataFrame:
    """The attempt that counts for each batch: the first that was entered."""
    entries = f"{path}/ledger"
    place = spark._jvm.org.apache.hadoop.fs.Path(entries)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER).select("batch", "attempt")
    entered = spark.read.schema(LEDGER).parquet(entries)
    return entered.groupBy("batch").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def write_batch(df: DataFrame, path: str, batch: str, ts: str = "ts", format: str = "parquet") -> None:
    """Append ``df`` by UTC day as the batch of that name; a batch that is written again appears once.

    Rows go to a folder of this attempt's own, and only when all are there is the attempt entered in the ledger beside
    them. So a batch that a restarted stream replays, one written by two drivers, and one that broke off half-way are
    all read once or not at all. A batch that has been entered is not written again.
    """
    if not _ledger(df.sparkSession, path).filter(F.col("batch") == batch).isEmpty():
        return
    attempt = uuid.uuid4().hex
    rows = df.withColumns({"day": F.to_date(ts), "attempt": F.lit(attempt)})
    (
        rows.repartition(F.col("day"), F.hour(ts)).write.mode("append").option("compression", "zstd" if format == "parquet" else "gzip")
        .partitionBy("day", "attempt").format(format).save(f"{path}/rows")
    )
    entry = df.sparkSession.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def read_batches(spark, path: str, schema: str | None = None, format: str = "parquet") -> DataFrame:
    """The rows of all batches in the ledger, with their ``day``; other attempts' folders are not opened."""
    reader = spark.read.format(format).option("mergeSchema", "true")
    rows = (reader.schema(f"{schema}, day date, attempt string") if schema else reader).load(f"{path}/rows")
    return rows.join(_ledger(spark, path).select("attempt"), "attempt", "left_semi").drop("attempt")


def micro_rows(summary: DataFrame, levels: DataFrame, walls: DataFrame, keys: Sequence[str], n: int = 30) -> DataFrame:
    """Order-book summary rows with the best levels and the walls of each side as JSON text."""
    keys = list(keys)

    def packed(rows: DataFrame, side: str, name: str) -> DataFrame:
        best = F.sort_array(F.collect_list(F.struct("rank", "price", "qty")))
        js = F.to_json(F.transform(F.slice(best, 1, n), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty"))))
        return rows.filter((F.col("side") == side) & (F.col("rank") <= n)).groupBy(*keys).agg(js.alias(name))

    out = summary
    for rows, tag in ((levels, "s"), (walls, "_walls")):
        for side in ("bid", "ask"):
            out = out.join(packed(rows, side, f"{side}{tag}_json"), keys, "left")
    return out


def write_source_tables(sources: dict[str, Sequence[DataFrame]], path: str) -> None:
    """One parquet folder per source: the union of its parts' columns, in name order."""
    for name, parts in sources.items():
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def write_state_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append JSON lines per UTC day, stamped with the time of loading."""
    rows = df.withColumns({"day": F.to_date(ts), "logged_at": F.current_timestamp()})
    rows.write.mode("append").partitionBy("day").json(path)


def write_models(models: DataFrame, path: str) -> None:
    """Model rows by fit date; refitting a date replaces that date only."""
    (
        models.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("fit_date")
        .parquet(path)
    )
