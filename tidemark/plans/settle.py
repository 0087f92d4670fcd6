"""Cut a plan by writing it to a table in the cluster's shared folder.

Multi-pass operators read their input more than once; settling a small derived table (bars, not ticks) first keeps the
expensive scan to one pass and lets a lost executor restart from the table instead of from the ticks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where the session names none, one inside its warehouse.

    Executors on other machines must see it. So on a cluster a warehouse on a machine's own disk, which is Spark's default,
    is an error and not a silent choice.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_settled"
        if not spark.sparkContext.master.startswith("local[") and base.split(":", 1)[0] in ("file", base):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; the file system removes it when the application ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as parquet and read back."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
