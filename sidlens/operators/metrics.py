"""Hits and ranking metrics of beams under the code, item and product protocols.

First hits come from array functions and equi-joins on SIDs; every metric is one
aggregate over rows. Positions count undecodable candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sid as S
from ..functions.stats import discount
from .catalog import enriched, sid_groups

KS = (1, 3, 5, 10, 20, 50)


def code_rank(predict: Column, output: Column) -> Column:
    """Zero-based first position of the target's SID, or null."""
    p = F.array_position(predict, output)
    return F.when(p > 0, p - 1)


def hr_ndcg(beam: DataFrame, ks=KS) -> DataFrame:
    """(k, n_rows, hits, hr, ndcg) by exact SID match."""
    r = beam.select(code_rank(F.col("predict"), F.col("output")).alias("rank")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("rank") < F.col("k"), F.lit(False))
    return r.groupBy("k").agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("hr"), F.round(F.avg(F.when(hit, discount(F.col("rank"))).otherwise(0.0)), 6).alias("ndcg"))


def audit(beam: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: counts of candidates that no item has, those with a token that no item has, wrong token counts, duplicates, empties, over all occurrences."""
    known = catalog.select("sid").distinct().withColumn("known", F.lit(1))
    tokens = catalog.select(F.explode(S.tokens(F.col("sid"))).alias("token")).distinct()
    slots = beam.select("row_id", F.posexplode("predict").alias("pos", "raw")).withColumn("sid", S.normalize(F.col("raw")))
    n_tokens = F.size(S.tokens(F.col("sid")))
    per = slots.join(known, "sid", "left").agg(
        F.count("*").alias("n_predictions"),
        F.count_if(F.col("known").isNull()).alias("illegal_sids"),
        F.count_if(n_tokens != 3).alias("wrong_length"),
        F.count_if(F.col("sid") == "").alias("empty_predictions"),
    )
    rows = beam.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.size("predict") - F.size(F.array_distinct("predict"))), F.lit(0)).alias("duplicates"),
        F.count_if(F.size("predict") > F.size(F.array_distinct("predict"))).alias("rows_with_duplicates"),
        F.array_join(F.array_sort(F.collect_set(F.size("predict"))), ",").alias("beam_sizes"),
    )
    # Only a candidate that no item has can hold such a token.
    unknown = slots.join(known, "sid", "left_anti").select("row_id", "pos", F.explode(S.tokens(F.col("sid"))).alias("token"))
    illegal = unknown.join(tokens, "token", "left_anti").select("row_id", "pos").distinct().agg(F.count("*").alias("illegal_tokens"))
    return rows.crossJoin(per).crossJoin(illegal)  # one row each


def order_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_id, a, b): rows of two splits (row_id, target) whose targets differ, or that one of them lacks; none where both hold the same rows in the same order."""
    r = a.select("row_id", F.col("target").alias("a")).join(b.select("row_id", F.col("target").alias("b")), "row_id", "full_outer")
    return r.where(~F.col("a").eqNullSafe(F.col("b")))


def unique_in_both(rows: DataFrame, catalog_a: DataFrame, catalog_b: DataFrame) -> DataFrame:
    """(row_id) of the rows whose target has a SID of its own in both catalogs."""
    own = [c.join(sid_groups(c).where("n_items = 1").select("sid"), "sid").select(F.col("item").alias("target")) for c in (catalog_a, catalog_b)]
    return rows.select("row_id", "target").join(own[0], "target", "left_semi").join(own[1], "target", "left_semi").select("row_id")


def illegal_examples(beam: DataFrame, catalog: DataFrame, n: int = 10) -> DataFrame:
    """The first n candidates that no item has, by row and position."""
    slots = beam.select("row_id", F.posexplode("predict").alias("pos", "sid"))
    return slots.join(catalog.select("sid").distinct(), "sid", "left_anti").orderBy("row_id", "pos").limit(n).select("row_id", "pos", "sid")


def candidates(beam: DataFrame, k: int) -> DataFrame:
    """(row_id, pos, sid) of the first k candidates."""
    return beam.select("row_id", F.posexplode(F.slice("predict", 1, k)).alias("pos", "sid"))


def first_hits(beam: DataFrame, catalog: DataFrame, k: int = 10, stop_at_ambiguous: bool = True, own_key: bool = True, product: bool = True) -> DataFrame:
    """Per row, whatever it hits: code_pos, strict_pos, fraction, product_pos, product_fraction and flags of its target.

    A strict hit is a candidate that decodes to the target alone; a code hit any
    that is the target's SID, of which the share is 1/k. A product hit decodes
    to the target's product alone. With stop_at_ambiguous, a candidate that
    holds the product among others ends the search for a product hit. With
    own_key the target keeps its product even if its SID is ambiguous. Targets
    the catalog doesn't know get no credit and count as shared and ambiguous.
    Without `product`, its columns are left out and candidates need no lookup.
    """
    c = enriched(catalog)
    own = beam.select("row_id", "target", "predict").join(c.select(F.col("item").alias("target"), F.col("sid").alias("tsid"), F.col("key").alias("tkey"), F.col("n_items").alias("t_items"), F.col("n_keys").alias("t_keys")), "target", "left")
    if not own_key:
        own = own.withColumn("tkey", F.when(F.col("t_keys") == 1, F.col("tkey")))
    pos = code_rank(F.slice("predict", 1, k), F.col("tsid"))
    columns = {
        "row_id": F.col("row_id"),
        "target": F.col("target"),
        "code_pos": pos,
        "strict_pos": F.when(F.col("t_items") == 1, pos),
        "fraction": F.when(pos.isNotNull(), 1 / F.col("t_items")).otherwise(0.0),
    }
    if product:
        slots = own.select("row_id", "tkey", F.posexplode(F.slice("predict", 1, k)).alias("pos", "sid"))
        # Candidates that hold the target's product: an equi-join on (sid, key).
        keys = c.groupBy("sid", "key").agg(F.first("n_keys").alias("n_keys"))
        held = slots.join(keys, (slots["sid"] == keys["sid"]) & (slots["tkey"] == keys["key"])).groupBy("row_id").agg(F.min("pos").alias("any_pos"), F.min_by("n_keys", "pos").alias("any_keys"), F.min(F.when(F.col("n_keys") == 1, F.col("pos"))).alias("unique_pos"))
        own = own.join(held, "row_id", "left")
        columns["product_pos"] = F.when(F.col("any_keys") == 1, F.col("any_pos")) if stop_at_ambiguous else F.col("unique_pos")
        columns["product_fraction"] = F.when(F.col("any_pos").isNotNull(), 1 / F.col("any_keys")).otherwise(0.0)
    columns["unique_target"] = F.coalesce(F.col("t_items") == 1, F.lit(False))
    columns["ambiguous_target"] = F.coalesce(F.col("t_keys") > 1, F.lit(True))
    return own.select(*[x.alias(n) for n, x in columns.items()])


def _rates(pos: str, prefix: str) -> list[Column]:
    hit = F.col(pos).isNotNull()
    return [F.count_if(hit).alias(f"{prefix}_hits"), F.round(F.avg(hit.cast("double")), 6).alias(f"{prefix}_hr"), F.round(F.avg(F.when(hit, discount(F.col(pos))).otherwise(0.0)), 6).alias(f"{prefix}_ndcg")]


def item_level(beam: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """(bucket, n_rows, code and strict rates, fraction): all rows, and those whose target's SID is its own or shared. Empty buckets don't appear."""
    h = first_hits(beam, catalog, k)
    bucket = F.explode(F.array(F.lit("all"), F.when(F.col("unique_target"), "unique_target").otherwise("shared_target")))
    return h.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n_rows"), *_rates("code_pos", "code"), *_rates("strict_pos", "strict"), F.round(F.avg("fraction"), 6).alias("fraction"))


def product_level(beam: DataFrame, catalog: DataFrame, k: int = 10, **options) -> DataFrame:
    """(bucket, n_rows, product rates, fraction): all rows, and those whose target's SID is of one product or ambiguous."""
    h = first_hits(beam, catalog, k, **options)
    bucket = F.explode(F.array(F.lit("all"), F.when(F.col("ambiguous_target"), "ambiguous_target").otherwise("unambiguous_target")))
    return h.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n_rows"), *_rates("product_pos", "product"), F.round(F.avg("product_fraction"), 6).alias("fraction"))


def hit_columns(beam: DataFrame, catalog: DataFrame, k: int = 10, protocols: Sequence[str] = ("code", "strict", "product")) -> DataFrame:
    """(row_id, code, strict, product) as 0/1, of the protocols asked for."""
    h = first_hits(beam, catalog, k, product="product" in protocols)
    return h.select("row_id", *[F.col(f"{p}_pos").isNotNull().cast("int").alias(p) for p in protocols])


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_id, a, b) of two (row_id, hit) tables; raises if a row is in one only."""
    both = a.select("row_id", F.col("hit").alias("a")).join(b.select("row_id", F.col("hit").alias("b")), "row_id", "full_outer")
    missing = F.col("a").isNull() | F.col("b").isNull()
    # A null hit can only come from a missing row here.
    return both.select("row_id", F.when(missing, F.raise_error(F.lit("the two sides have different rows")).cast("int")).otherwise(F.col("a")).alias("a"), "b")


def paired_table(pairs: DataFrame) -> DataFrame:
    """One row on (a, b): the 2 x 2 table, rates and net change."""
    a, b = F.col("a") == 1, F.col("b") == 1
    return pairs.agg(
        F.count("*").alias("n_rows"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
        F.count_if(a & b).alias("both_hit"),
        F.count_if(~a & ~b).alias("neither"),
        (F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).alias("net"),
        F.round(F.avg("a"), 6).alias("hr_a"),
        F.round(F.avg("b"), 6).alias("hr_b"),
    )


def collision_rows(a: DataFrame, b: DataFrame, catalog_a: DataFrame, catalog_b: DataFrame, k: int = 10) -> DataFrame:
    """(subset, row_id, pa, pb): each row's first hits, once as "all", once as "collision" if its target shares its SID in either catalog, else as "clean"."""
    shared = sid_groups(catalog_a).where("n_items > 1").select("sid").join(catalog_a, "sid").select("item").union(sid_groups(catalog_b).where("n_items > 1").select("sid").join(catalog_b, "sid").select("item")).distinct()
    ra = a.select("row_id", "target", code_rank(F.slice("predict", 1, k), F.col("output")).alias("pa"))
    rb = b.select("row_id", code_rank(F.slice("predict", 1, k), F.col("output")).alias("pb"))
    r = ra.join(rb, "row_id").join(shared.select(F.col("item").alias("target"), F.lit(True).alias("shared")), "target", "left")
    subset = F.explode(F.array(F.lit("all"), F.when(F.coalesce("shared", F.lit(False)), "collision").otherwise("clean")))
    return r.withColumn("subset", subset).select("subset", "row_id", "pa", "pb")


def collision_confound(a: DataFrame, b: DataFrame, catalog_a: DataFrame, catalog_b: DataFrame, k: int = 10) -> DataFrame:
    """(subset, n_rows, hr and ndcg of each side): all rows, and those whose target shares its SID in either catalog, or in none."""
    rates = [x for p, n in (("pa", "a"), ("pb", "b")) for x in _rates(p, n)]
    return collision_rows(a, b, catalog_a, catalog_b, k).groupBy("subset").agg(F.count("*").alias("n_rows"), *rates)


def reachability(beam: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: rows whose target's SID is anywhere in the beam, and of these those whose SID is the target's alone."""
    h = first_hits(beam, catalog, 1_000_000, product=False)
    return h.agg(F.count("*").alias("n_rows"), F.count("code_pos").alias("in_beam"), F.count("strict_pos").alias("strict_in_beam"), F.round(F.avg(F.col("code_pos").isNotNull().cast("double")), 6).alias("code_ceiling"), F.round(F.avg(F.col("strict_pos").isNotNull().cast("double")), 6).alias("strict_ceiling"))
