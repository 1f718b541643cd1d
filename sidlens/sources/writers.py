"""Writers of reports, splits, info files and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import csv_line, one_file


def report(df: DataFrame, path: str) -> None:
    """Each row as a line of JSON."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def examples(df: DataFrame, path: str) -> None:
    df.select("history", "target").write.mode("overwrite").json(path)


def split_csv(df: DataFrame, path: str, order: str = "row_id") -> None:
    """A CSV with header, minimal quotes and LF line ends, in order; row_id isn't written. A path that ends in .csv is one file, any other a folder of part files. Cells stay byte for byte, white space around them too."""
    columns = [c for c in df.columns if c not in ("row_id", order)]
    if path.endswith(".csv"):
        head = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\r\n') else c for c in columns)
        one_file(df.select(F.col(order).alias("order"), csv_line(df, columns).alias("line")), path, head)
        return
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "lineSep": "\n", "emptyValue": ""}
    df.orderBy(order).select(*columns).write.mode("overwrite").options(**kept).option("header", True).csv(path)


def info_file(lines: DataFrame, path: str) -> None:
    """Lines (item, line) in order of item: one file where the path ends in .txt or .tsv, else a folder of part files."""
    if path.endswith((".txt", ".tsv")):
        one_file(lines.select(F.col("item").alias("order"), "line"), path)
        return
    lines.orderBy("item").select("line").write.mode("overwrite").text(path)


def model(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON object as a text file."""
    spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def predictor(spark: SparkSession, net, vocab: DataFrame, metrics: dict, path: str) -> None:
    """Weights, vocabulary and metrics of a predictor, each a folder under the path."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in net.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    model(spark, metrics, f"{path}/metrics")
