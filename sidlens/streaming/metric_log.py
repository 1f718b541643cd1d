"""The curve of a growing metric log, kept up to date as lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import METRIC_LOG


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (log, step, hr10) from JSON-lines files that appear in a folder; malformed lines, errors and lines without hr@10 go."""
    raw = spark.readStream.schema(METRIC_LOG).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.withColumn("log", F.col("_metadata.file_name")).where("error IS NULL AND `hr@10` IS NOT NULL").select("log", "step", F.col("`hr@10`").alias("hr10"))


def curve(stream: DataFrame) -> DataFrame:
    """(log, points, start, best, best_step, final) so far; its state is one row per log."""
    return stream.groupBy("log").agg(F.count("*").alias("points"), F.min_by("hr10", "step").alias("start"), F.max("hr10").alias("best"), F.min_by("step", F.struct(-F.col("hr10"), F.col("step"))).alias("best_step"), F.max_by("hr10", "step").alias("final"))


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Writes the whole curve to `path` after each batch, replacing what was there; restarts go on from the checkpoint."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = curve(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()
