"""Sessions and written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(cores: str = "*", partitions: int = 8, name: str = "sidlens") -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Unset, it is one of our own, removed at exit, if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints/sidlens-{os.getpid()}"
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """The rows as Parquet in the shared folder, read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` gave and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_running(df: DataFrame, value: Column, *order: str, name: str) -> DataFrame:
    """Running sums in an order, each row's own value included, without gathering the rows: ranges are summed apart, then shifted by what lies before them."""
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row per range.
    before = dealt.groupBy("_range").agg(F.sum(value).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("_at", F.sum(value).over(w)).join(F.broadcast(before), "_range").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_at")).drop("_range", "_n", "_before", "_at")


def with_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Dense zero-based numbers in an order, by ranges as in with_running."""
    return with_running(df, F.lit(1), *order, name=name).withColumn(name, (F.col(name) - 1).cast("long"))
