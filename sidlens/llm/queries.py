"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, hard_negatives, jaccard_join, merkle, packing, quality, secrets, simhash, suffix_dedup, token_count, topk, warc
from .common import documents


#: Words of a passage that op8 counts as repeated in its further column.
PASSAGE_WORDS = 51


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file: in the folder SIDLENS_TOKENIZERS names, else where the package public_tokenizers is installed."""
    folder = os.environ.get("SIDLENS_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir, "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(documents(spark, sf_dir, "doc_id", "text"), words=3, num=90, den=100, count_links=True)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir, "doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.capture_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.likeness_to_edited(documents(spark, sf_dir, "doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure_repeats(documents(spark, sf_dir, "doc_id", "text"), least_words=PASSAGE_WORDS)


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs, net).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, vector_column="embedding")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *merkle.FIELDS)
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.verified(docs, changes={"text": lower}, when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_components(documents(spark, sf_dir, "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_jaccard_components, op3_secret_scan, op4_best_fit_packing, op5_warc_captures, op6_bpe_round_trip, op7_fingerprints, op8_suffix_dedup, op9_quality_scores, op10_exact_top_k, op11_merkle_manifest, op12_simhash_components, op13_hard_negatives)}



def _merkle_sql(levels: int, top_levels: int) -> str:
    """Trees of 16**levels leaves and 16**top_levels groups at most. t: nodes by level, r: their runs as lists; u and v: those of the tree over the groups."""

    def grown(name: str, runs: str, level: int) -> str:
        return f"""{runs}{level} AS (SELECT s, idx // 16 AS run, any_value(n) AS n, list(d ORDER BY idx) AS ds FROM {name}{level} WHERE n > 1 GROUP BY s, idx // 16),
        {name}{level + 1} AS (SELECT s, run AS idx, sha256(array_to_string(ds, '')) AS d, (n + 15) // 16 AS n FROM {runs}{level})"""

    def step(runs: str, level: int) -> str:
        return f"CASE WHEN {runs}{level}.ds IS NOT NULL THEN [{{'a': {runs}{level}.ds[1:at % 16], 'b': {runs}{level}.ds[at % 16 + 2:]}}] ELSE [] END".replace("at", f"({'l.idx' if runs == 'r' else 'g.idx'} // {16**level})")

    fields = lambda text: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: list_reduce([CAST(1 AS BIGINT), 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(h, c)), CAST(4294967295 AS BIGINT)), 4294967295)"
    joins = " ".join(f"LEFT JOIN r{i} ON r{i}.s = l.s AND r{i}.run = l.idx // {16 ** (i + 1)}" for i in range(levels)) + " " + " ".join(f"LEFT JOIN v{i} ON v{i}.run = g.idx // {16 ** (i + 1)}" for i in range(top_levels))
    path = " || ".join([*(step("r", i) for i in range(levels)), *(step("v", i) for i in range(top_levels))])
    return f"""WITH l AS (SELECT doc_id, coalesce('s' || source, '') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
            sha256({fields("text")}) AS d, CASE WHEN {crc} % 5 = 0 THEN sha256({fields(lower)}) END AS changed FROM documents),
        t0 AS (SELECT s, idx, d, n FROM l), {", ".join(grown("t", "r", i) for i in range(levels))},
        g AS (SELECT s AS of, d AS subroot, row_number() OVER (ORDER BY s) - 1 AS idx, count(*) OVER () AS n FROM ({" UNION ALL ".join(f"SELECT s, d FROM t{i} WHERE n = 1" for i in range(levels + 1))})),
        u0 AS (SELECT 0 AS s, idx, subroot AS d, n FROM g), {", ".join(grown("u", "v", i) for i in range(top_levels))},
        w AS ({" UNION ALL ".join(f"SELECT d AS root FROM u{i} WHERE n = 1" for i in range(top_levels + 1))}),
        p AS (SELECT doc_id, d AS leaf, coalesce(changed, d) AS own, subroot, root, {path} AS path FROM l JOIN g ON g.of = l.s, w {joins})
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(list_transform(path, lambda x: x.a || x.b)), '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM (SELECT *, list_reduce(list_transform(path, lambda x: {{'a': array_to_string(x.a, ''), 'b': array_to_string(x.b, ''), 'h': ''}}), lambda h, x: {{'a': '', 'b': '', 'h': sha256(x.a || h.h || x.b)}}, {{'a': '', 'b': '', 'h': own}}).h AS folded_root FROM p)"""


#: DuckDB SQL by query.
SQL: dict[str, str] = {
    "op5_warc_captures": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, d.payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""",
    "op10_exact_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_merkle_manifest": _merkle_sql(5, 3),
    "op13_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
