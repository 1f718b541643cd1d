"""Where hits come from: popularity, copied histories, shared SIDs, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sid as S
from .cooc import target_counts
from .metrics import first_hits

#: The buckets of train target counts: name, least, most.
BUCKETS = (("0", 0, 0), ("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-100", 21, 100), (">100", 101, 1 << 62))

#: The subsets of collision_rows.
SUBSETS = ("all", "clean", "collision")


def hits_of(rows: DataFrame) -> DataFrame:
    """(subset, row_id, a, b) as 0/1 of collision_rows."""
    return rows.select("subset", "row_id", F.col("pa").isNotNull().cast("int").alias("a"), F.col("pb").isNotNull().cast("int").alias("b"))


def popularity_buckets(beam: DataFrame, catalog: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """(bucket, n_rows, share, hr, strict_hr, coverage, level1): by how often targets are train targets, and all; empty buckets have zeros."""
    counts = target_counts(train).select(F.col("item").alias("target"), F.col("n").alias("seen"))
    h = first_hits(beam, catalog, k)
    l1 = S.level1_text(F.col("output"))
    r = beam.select("row_id", "target", F.coalesce(F.array_contains("predict", F.col("output")), F.lit(False)).alias("cover"), F.coalesce(F.exists("predict", lambda p: S.level1_text(p) == l1), F.lit(False)).alias("l1"))
    r = r.join(h.select("row_id", "code_pos", "strict_pos"), "row_id").join(counts, "target", "left")
    seen = F.coalesce("seen", F.lit(0))
    name = F.lit(None).cast("string")
    for n, lo, hi in BUCKETS:
        name = F.when(seen.between(lo, hi), n).otherwise(name)
    r = r.withColumn("bucket", F.explode(F.array(F.lit("all"), name)))
    g = r.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.count("code_pos").alias("h"), F.count("strict_pos").alias("s"), F.count_if("cover").alias("c"), F.count_if("l1").alias("l"))
    names = beam.sparkSession.createDataFrame([(n,) for n, _, _ in BUCKETS] + [("all",)], "bucket string")
    g = names.join(g, "bucket", "left").fillna(0)
    total = g.where("bucket = 'all'").select(F.greatest("n_rows", F.lit(1)).alias("t"))
    n = F.greatest("n_rows", F.lit(1))
    rate = lambda c, a: F.round(F.col(c) / n, 4).alias(a)
    return g.crossJoin(total).select("bucket", "n_rows", F.round(F.col("n_rows") / F.col("t"), 4).alias("share"), rate("h", "hr"), rate("s", "strict_hr"), rate("c", "coverage"), rate("l", "level1"))


def history_copy(beam: DataFrame, rows: DataFrame, catalog: DataFrame, beam_width: int = 50) -> DataFrame:
    """One row: shares of beam slots that are history items, of rows whose first candidate is one, whose target is one, and the latter among the former."""
    h = rows.select("row_id", F.explode("hist").alias("item")).join(catalog.select("item", "sid"), "item").groupBy("row_id").agg(F.collect_set("sid").alias("own"))
    r = beam.select("row_id", "target", "predict").join(h, "row_id", "left").join(rows.select("row_id", "hist"), "row_id")
    own = F.coalesce("own", F.array().cast("array<string>"))
    r = r.select(F.size(F.filter("predict", lambda p: F.array_contains(own, p))).alias("slots"), F.coalesce(F.array_contains(own, F.get("predict", F.lit(0))), F.lit(False)).alias("copy"), F.array_contains("hist", F.col("target")).alias("repeat"))
    both = F.col("copy") & F.col("repeat")
    return r.agg(
        F.count("*").alias("n_rows"),
        F.round(F.sum("slots") / (F.count("*") * beam_width), 6).alias("slot_share"),
        F.round(F.avg(F.col("copy").cast("double")), 6).alias("copy_first"),
        F.round(F.avg(F.col("repeat").cast("double")), 6).alias("target_repeat"),
        F.round(F.try_divide(F.count_if(both), F.count_if("copy")), 6).alias("repeat_of_copy_first"),
    )


def shared_group_sizes(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(n_items, n_targets, n_rows): distinct test targets and rows by the size of the group that shares the target's SID."""
    g = catalog.groupBy("sid").agg(F.count("*").alias("n_items")).join(catalog, "sid").select(F.col("item").alias("target"), "n_items")
    return rows.join(g, "target").groupBy("n_items").agg(F.count_distinct("target").alias("n_targets"), F.count("*").alias("n_rows"))


def top_targets(rows: DataFrame, catalog_a: DataFrame, catalog_b: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent targets, seen first of equal ones, with the sizes of their groups in both catalogs (0: unknown)."""
    t = rows.groupBy("target").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row")).orderBy(F.desc("n_rows"), "first_row").limit(n)
    size = lambda c, a: c.groupBy("sid").agg(F.count("*").alias(a)).join(c, "sid").select(F.col("item").alias("target"), a)
    return t.join(size(catalog_a, "group_a"), "target", "left").join(size(catalog_b, "group_b"), "target", "left").fillna(0, ["group_a", "group_b"]).select("target", "n_rows", "group_a", "group_b")


def shared_rows(beams: dict[int, tuple[DataFrame, DataFrame]], catalog_a: DataFrame, catalog_b: DataFrame, k: int = 10) -> DataFrame:
    """(seed, subset, n_rows, hits_a, hits_b): strict hits of two arms on rows whose target shares its SID in catalog a, and on the others."""
    out = None
    for seed, (a, b) in beams.items():
        ha = first_hits(a, catalog_a, k, product=False).select("row_id", "unique_target", "target", F.col("strict_pos").isNotNull().alias("a"))
        hb = first_hits(b, catalog_b, k, product=False).select("row_id", F.col("strict_pos").isNotNull().alias("b"))
        known = catalog_a.select(F.col("item").alias("target"), F.lit(True).alias("known"))
        r = ha.join(hb, "row_id").join(known, "target", "left")
        subset = F.when(F.coalesce("known", F.lit(False)) & ~F.col("unique_target"), "shared").otherwise("unique")
        r = r.groupBy(subset.alias("subset")).agg(F.count("*").alias("n_rows"), F.count_if("a").alias("hits_a"), F.count_if("b").alias("hits_b")).select(F.lit(seed).alias("seed"), "*")
        out = r if out is None else out.union(r)
    return out


def metric_curve(log: DataFrame) -> DataFrame:
    """(log, points, start, best, best_step, final, gain_best, gain_final) of (log, step, hr10): the first step, the first best, the last."""
    return log.groupBy("log").agg(
        F.count("*").alias("points"),
        F.round(F.min_by("hr10", "step"), 6).alias("start"),
        F.round(F.max("hr10"), 6).alias("best"),
        F.min_by("step", F.struct(-F.col("hr10"), F.col("step"))).alias("best_step"),
        F.round(F.max_by("hr10", "step"), 6).alias("final"),
        F.round(F.max("hr10") - F.min_by("hr10", "step"), 6).alias("gain_best"),
        F.round(F.max_by("hr10", "step") - F.min_by("hr10", "step"), 6).alias("gain_final"),
    )


def curve_summary(curves: DataFrame) -> DataFrame:
    """One row over metric_curve's: runs, means of start, best and final, and in how many runs the best beats the start."""
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("start", "best", "final")]
    return curves.agg(F.count("*").alias("runs"), *means, F.count_if(F.col("gain_best") > 0).alias("wins"))
