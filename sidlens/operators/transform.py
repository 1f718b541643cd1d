"""Rewriting splits under another catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sid as S
from ..plans.session import written


def marked(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (row_id, target, hist) with new_sid, new_hist (SIDs in order) and how many history items are missing."""
    i = index.select("item", "sid")
    h = rows.select("row_id", F.posexplode_outer("hist").alias("pos", "item")).join(i, "item", "left")
    g = h.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sid"))), lambda s: s["sid"]).alias("new_hist"), F.count_if(F.col("pos").isNotNull() & F.col("sid").isNull()).alias("missing"), F.min(F.when(F.col("pos").isNotNull() & F.col("sid").isNull(), F.col("item"))).alias("missing_item"))
    return rows.join(g, "row_id").join(i.select(F.col("item").alias("target"), F.col("sid").alias("new_sid")), "target", "left")


def kept(m: DataFrame) -> DataFrame:
    """Marked rows that have a SID for their target and all history items."""
    return m.where("new_sid IS NOT NULL AND missing = 0").drop("missing", "missing_item")


def report_of(m: DataFrame) -> DataFrame:
    """One row of counters over marked rows. Items missing from histories only are counted apart from missing targets; the five least of these are given."""
    whole = (F.col("missing") == 0) & F.col("new_sid").isNotNull()
    some = m.where("new_sid IS NULL AND target IS NOT NULL").select("target").distinct().orderBy("target").limit(5)
    examples = some.agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("examples"))
    counters = m.agg(
        F.count("*").alias("n_rows"),
        F.count_if(whole).alias("kept"),
        F.count_if(F.col("new_sid").isNull()).alias("missing_targets"),
        F.count_if(F.col("new_sid").isNotNull() & (F.col("missing") > 0)).alias("missing_history"),
        F.coalesce(F.sum(F.when(whole, F.size("hist"))), F.lit(0)).alias("history_items"),
        F.coalesce(F.max(F.when(whole, F.size("hist"))), F.lit(0)).alias("max_history"),
    )
    return counters.crossJoin(examples)  # one row each


def remap(rows: DataFrame, index: DataFrame) -> DataFrame:
    """All columns and new_sid, new_hist; rows whose target or any history item the index misses go."""
    return kept(marked(rows, index))


def remap_report(rows: DataFrame, index: DataFrame) -> DataFrame:
    """report_of all rows."""
    return report_of(written(marked(rows, index), "marked"))


def remapped(raw: DataFrame, rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A split's records (row_id and its columns) with the SIDs of another index, all other columns as they were, and the report on it. Rows are marked once and written, and both are read from there: metrics observed on the way would count a lost executor's rows again."""
    m = written(marked(rows, index), "marked")
    new = kept(m).select("row_id", "new_sid", S.list_literal(F.col("new_hist")).alias("new_history"))
    out = raw.join(new, "row_id").withColumn("item_sid", F.col("new_sid")).withColumn("history_item_sid", F.col("new_history"))
    return out.select("row_id", *[c for c in raw.columns if c != "row_id"]), report_of(m)
