"""Readers of splits, catalogs, results, logs and vectors. Positions in a file become row_id."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sid as S
from .entries import json_entries
from .lines import csv_records, numbered_lines
from .vectors import npy_vectors as npy_vectors


def split_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns text, and row_id by place in the file."""
    return csv_records(spark, path)


def interactions(spark: SparkSession, path: str) -> DataFrame:
    """A split's typed columns, as of `typed`."""
    return typed(split_csv(spark, path))


def typed(raw: DataFrame) -> DataFrame:
    """(row_id, user_id, item_id, history_ids, history_sids) of a split's records; a missing history or user column counts as empty."""
    has = lambda c: F.col(c) if c in raw.columns else F.lit("")
    return raw.select("row_id", F.coalesce(has("user_id"), F.lit("")).alias("user_id"), F.trim("item_id").cast("long").alias("item_id"), S.parse_ids(has("history_item_id")).alias("history_ids"), S.parse_sid_list(has("history_item_sid")).alias("history_sids"))


def split_file(spark: SparkSession, root: str, prefix: str) -> str:
    """The first CSV, by name, under a folder whose name starts with the prefix."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.csv").load(root).agg(F.min("path").alias("p")).first()["p"]
    if found is None:
        raise FileNotFoundError(f"no {prefix}*.csv under {root}")
    return found


#: An entry that isn't what it should be is an error.
STRICT = {"mode": "FAILFAST"}


def results(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, predict, output) of a result file: a list of entries, or a list of such lists, one after the other; a folder's files follow each other. Many tasks read a large file."""
    e = F.from_json("text", "predict array<string>, output string", STRICT)
    rows = json_entries(spark, path).select(F.col("entry").alias("row_id"), e.alias("e"))
    return rows.select("row_id", F.transform(F.coalesce("e.predict", F.array().cast("array<string>")), S.normalize).alias("predict"), S.normalize(S.target_of(F.col("e.output"))).alias("output"))


def _members(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(item, value) of an object's members, many tasks reading a large file."""
    m = F.from_json("text", f"map<string,{kind}>", STRICT)
    return json_entries(spark, path, members=True).select(F.explode(m).alias("item", "value")).withColumn("item", F.col("item").cast("long"))


def index_json(spark: SparkSession, path: str) -> DataFrame:
    """(item, tokens, sid) of an index object."""
    return _members(spark, path, "array<string>").select("item", F.col("value").alias("tokens"), S.join_tokens(F.col("value")).alias("sid"))


def item_meta(spark: SparkSession, path: str) -> DataFrame:
    """(item, title) of an item metadata object."""
    return _members(spark, path, "struct<title:string>").select("item", "value.title")


def catalog(spark: SparkSession, index: str, meta: str | None = None) -> DataFrame:
    """(item, sid, title); items without metadata raise, as nothing can be credited to them."""
    i = index_json(spark, index).select("item", "sid")
    if meta is None:
        return i.withColumn("title", F.lit(None).cast("string"))
    known = item_meta(spark, meta).withColumn("known", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no metadata for item "), F.col("item").cast("string"))).cast("string")
    return i.join(known, "item", "left").select("item", "sid", F.when(F.col("known").isNull(), missing).otherwise(F.col("title")).alias("title"))


def info_file(spark: SparkSession, path: str, titles: bool = False) -> DataFrame:
    """(sid, title, item) of a tab-separated info file without header; blank first cells go, missing cells are null. With titles, rows of one cell, which have none, go too."""
    cells = F.split("value", "\t")
    return spark.read.text(path).select(cells.alias("c")).select(F.trim(F.get("c", F.lit(0))).alias("sid"), F.get("c", F.lit(1)).alias("title"), F.get("c", F.lit(2)).alias("item")).where("sid <> ''").where(F.lit(True) if not titles else F.col("title").isNotNull())


def examples_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of an examples file: (row_id, history, target), and (line, error); blank lines count but don't appear."""
    text = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")
    r = text.select((F.col("line") + 1).alias("line"), F.from_json("value", "history array<string>, target string").alias("e"))
    error = F.when(F.col("e.history").isNull() | F.col("e.target").isNull(), "not an example").when(F.size("e.history") == 0, "empty history").when(~S.is_valid(F.col("e.target")) | F.exists("e.history", lambda s: ~S.is_valid(s)), "malformed SID")
    r = r.withColumn("error", error)
    return r.where("error IS NULL").select(F.col("line").cast("long").alias("row_id"), "e.history", "e.target"), r.where("error IS NOT NULL").select("line", "error")


def sid_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a split with SID columns: (row_id, history, target), and (line, error), lines from 2 on."""
    raw = split_csv(spark, path)
    history = S.parse_history(F.col("history_item_sid"))
    r = raw.select("row_id", history.alias("history"), F.col("item_sid").alias("target"))
    error = F.when(F.size("history") == 0, "empty history").when(~S.is_valid(F.col("target")) | F.exists("history", lambda s: ~S.is_valid(s)), "malformed SID")
    r = r.withColumn("error", error)
    return r.where("error IS NULL").drop("error"), r.where("error IS NOT NULL").select((F.col("row_id") + 2).alias("line"), "error")


METRIC_LOG = "step long, `hr@1` double, `hr@10` double, `ndcg@10` double, `hr@50` double, target_in_group double, seconds double, error string"


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a metric log that parse, have no error and do have hr@10, with the file as `log`."""
    return spark.read.schema(METRIC_LOG).option("mode", "DROPMALFORMED").json(path).withColumn("log", F.col("_metadata.file_name")).where("error IS NULL AND `hr@10` IS NOT NULL")


def json_object(spark: SparkSession, path: str) -> dict:
    """One JSON object of a file, or of a folder that a writer made."""
    return json.loads(spark.read.text(path, wholetext=True).where("trim(value) <> ''").first()["value"])


def reranker(spark: SparkSession, path: str) -> dict:
    """A reranker model; the names of a file without `index` are all in order. Raises where names and weights differ in number."""
    m = json_object(spark, path)
    index = m.get("index", list(range(len(m["features"]))))
    if not len(index) == len(m["weights"]):
        raise ValueError("features and weights differ in number")
    return m | {"index": index}


def paired_split(rows: DataFrame, beam: DataFrame) -> DataFrame:
    """Rows and their predictions by row_id; raises where one has more rows."""
    a, b = rows.count(), beam.count()
    if a != b:
        raise ValueError(f"{a} rows but {b} predictions")
    return rows.join(beam, "row_id")
