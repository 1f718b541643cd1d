"""One query per operator over the derived inputs, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sid as S
from ..functions.stats import u32
from ..operators import catalog as C
from ..operators import cooc, diagnose, features, learn, metrics, predictor, quality, rank, resample, sampling, transform, trie
from . import oracles
from .fixtures import Fixtures
from .session import with_index, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rounds of bootstraps, the operators' default.
ROUNDS = 2000
_INTERVAL = f"max(v) FILTER (r = {int(ROUNDS * 0.025)}) AS lo, max(v) FILTER (r = {int(ROUNDS * 0.975) - 1}) AS hi"
_REPORT = "n_rows, round(diff, 6) AS diff, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, lo > 0 OR hi < 0 AS significant"
#: A pointwise model of given weights, for scoring queries.
MODEL = {
    "features": list(features.POINTWISE),
    "mean": [2.0, 1.0, 0.1, 3.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 2.0, 0.5, -3.0, -6.0],
    "scale": [3.0, 1.0, 0.2, 1.0, 1.0, 1.0, 0.2, 0.1, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0],
    "weights": [0.8, 0.4, 0.3, 0.2, 1.5, 0.5, 0.3, 0.6, 0.2, 0.4, 0.0, -0.1, 0.1, 0.1],
    "bias": -0.5,
}
LIST_MODEL = {"features": list(features.LISTWISE), "mean": [*MODEL["mean"], 3.0, 0.0, 5.0, 2.0, 4.0, 3.0, 1.0], "scale": [*MODEL["scale"], 1.0, 1.0, 2.0, 1.0, 2.0, 2.0, 1.0], "weights": [*MODEL["weights"], -0.7, 0.3, -0.4, -0.2, -0.1, 0.05, 0.05]}


def query(sql: str | None = None):
    def add(f: Callable[[Fixtures], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracles.with_tables(sql)
        return f

    return add


def linear_sql(model: dict) -> str:
    return " + ".join([str(model.get("bias", 0.0)), *(f"(({n} - {m}) / {s}) * ({w})" for n, m, s, w in zip(model["features"], model["mean"], model["scale"], model["weights"], strict=True))])


# ---------------------------------------------------------------- SIDs, text, transforms

_FORMS = """SELECT item, 'angle' AS form, sid FROM cat_a UNION ALL SELECT item, 'slash', regexp_extract(sid, '<a_([0-9]+)>', 1) || '/' || item || '/x' FROM cat_a
    UNION ALL SELECT item, 'short', substr(sid, 1, length(sid) - 1) FROM cat_a UNION ALL SELECT item, 'gap', item || '//x' FROM cat_a"""


@query(f"""SELECT item, form, sid, CASE WHEN sid LIKE '<%' THEN regexp_matches(sid, '^(<[abc]_[0-9]+>){{3}}$') ELSE len(string_split(sid, '/')) = 3 AND NOT list_contains(string_split(sid, '/'), '') END AS valid FROM ({_FORMS})""")
def sid_validity(fx: Fixtures) -> DataFrame:
    c = fx.catalog()
    item = F.col("item").cast("string")
    forms = F.array(
        F.struct(F.lit("angle").alias("form"), "sid"),
        F.struct(F.lit("slash").alias("form"), F.concat(S.level1(F.col("sid")), F.lit("/"), item, F.lit("/x")).alias("sid")),
        F.struct(F.lit("short").alias("form"), F.expr("substr(sid, 1, length(sid) - 1)").alias("sid")),
        F.struct(F.lit("gap").alias("form"), F.concat(item, F.lit("//x")).alias("sid")),
    )
    return c.select("item", F.explode(forms).alias("f")).select("item", "f.form", "f.sid", S.is_valid(F.col("f.sid")).alias("valid"))


@query("SELECT item, array_to_string(regexp_extract_all(sid, '<[abc]_[0-9]+>'), '|') AS tokens, len(regexp_extract_all(sid, '<[abc]_[0-9]+>')) AS n_tokens, regexp_extract(sid, '^<a_[0-9]+>') AS prefix1, regexp_extract(sid, '^<a_[0-9]+><b_[0-9]+>') AS prefix2, substr(sid, 1, 7) AS cut7 FROM cat_a")
def sid_tokens(fx: Fixtures) -> DataFrame:
    s = F.col("sid")
    t = S.tokens(s)
    return fx.catalog().select("item", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n_tokens"), S.prefix(s, 1).alias("prefix1"), S.prefix(s, 2).alias("prefix2"), F.substring(s, 1, 7).alias("cut7"))


@query("SELECT item, l1, l2, CAST(l1 AS INT) AS a, CAST(regexp_extract(sid, '<b_([0-9]+)>', 1) AS INT) AS b, CAST(regexp_extract(sid, '<c_([0-9]+)>', 1) AS INT) AS c, '<a_' || l1 || '>' AS l1_text FROM enr_a")
def sid_levels(fx: Fixtures) -> DataFrame:
    s = F.col("sid")
    return fx.catalog().select("item", S.level1(s).alias("l1"), S.level2(s).alias("l2"), *[S.code(s, v).alias(v) for v in "abc"], S.level1_text(s).alias("l1_text"))


@query("SELECT item, sid AS normalized, sid AS head, sid AS plain, '' AS none FROM cat_a")
def normalize_pred(fx: Fixtures) -> DataFrame:
    raw = F.concat(F.lit(' \t"'), F.col("sid"), F.lit('"\n'))
    j = F.concat(F.lit('["'), F.col("sid"), F.lit('"]'))
    return fx.catalog().select("item", S.normalize(raw).alias("normalized"), S.target_of(j).alias("head"), S.target_of(F.col("sid")).alias("plain"), S.target_of(F.lit("[]")).alias("none"))


@query("SELECT item, key FROM enr_a")
def product_keys(fx: Fixtures) -> DataFrame:
    messy = F.concat(F.lit("\t "), F.upper(F.replace(F.col("title"), F.lit(" "), F.lit(" \n "))), F.lit("  "))
    return fx.catalog().select("item", S.product_key(messy).alias("key"))


@query("SELECT item, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 3))), ' ') AS tokens FROM cat_a")
def title_tokens(fx: Fixtures) -> DataFrame:
    return fx.catalog().select("item", F.array_join(F.array_sort(S.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("SELECT row_id, len(hist) AS n, list_sum(hist) AS total, len(hist) AS n_sids, len(hist) AS n_threes, len(hist) AS n_literal, 0 AS n_broken FROM test")
def history_parse(fx: Fixtures) -> DataFrame:
    raw = F.concat(F.lit("["), F.array_join(F.col("hist").cast("array<string>"), ", "), F.lit("]"))
    sids = F.transform("hist", lambda i: F.concat(F.lit("<a_"), i, F.lit("><b_1><c_2>")))
    ids = S.parse_ids(raw)
    return fx.rows().select(
        "row_id",
        F.size(ids).alias("n"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        F.size(S.parse_sid_list(S.list_literal(sids))).alias("n_sids"),
        F.size(S.parse_sid_list(F.array_join(sids, " "))).alias("n_threes"),
        F.size(S.parse_id_list(raw)).alias("n_literal"),
        F.size(S.parse_history(F.lit("[1, "))).alias("n_broken"),
    )


_NEW = "(SELECT item, sid FROM cat_b WHERE item % 97 <> 5)"


def _new_index(fx: Fixtures) -> DataFrame:
    return fx.catalog_b().where("item % 97 <> 5")


@query(f"""WITH m AS (SELECT map_from_entries(list((item, sid))) AS m FROM {_NEW}), r AS (SELECT row_id, target, m[target] AS new_sid, list_transform(hist, lambda i: m[i]) AS sids FROM test, m)
    SELECT row_id, target, new_sid, '[' || array_to_string(list_transform(sids, lambda x: chr(39) || x || chr(39)), ', ') || ']' AS new_history FROM r WHERE new_sid IS NOT NULL AND len(list_filter(sids, lambda x: x IS NULL)) = 0""")
def remap_sid(fx: Fixtures) -> DataFrame:
    return transform.remap(fx.rows(), _new_index(fx)).select("row_id", "target", "new_sid", S.list_literal(F.col("new_hist")).alias("new_history"))


@query(f"""WITH m AS (SELECT row_id, target, len(hist) AS k, n.sid AS new_sid, missing FROM test LEFT JOIN {_NEW} n ON n.item = target
    JOIN (SELECT row_id, count(*) FILTER (sid IS NULL) AS missing FROM (SELECT row_id, unnest(hist) AS item FROM test) LEFT JOIN {_NEW} USING (item) GROUP BY 1) USING (row_id))
    SELECT count(*) AS n_rows, count(*) FILTER (missing = 0 AND new_sid IS NOT NULL) AS kept, count(*) FILTER (new_sid IS NULL) AS missing_targets, count(*) FILTER (new_sid IS NOT NULL AND missing > 0) AS missing_history,
    coalesce(sum(k) FILTER (missing = 0 AND new_sid IS NOT NULL), 0) AS history_items, coalesce(max(k) FILTER (missing = 0 AND new_sid IS NOT NULL), 0) AS max_history,
    array_to_string(list_slice(list_sort(list(DISTINCT target) FILTER (new_sid IS NULL)), 1, 5), ',') AS examples FROM m""")
def remap_report(fx: Fixtures) -> DataFrame:
    return transform.remap_report(fx.rows(), _new_index(fx))


@query(f"SELECT row_id, target FROM test ORDER BY {oracles.u32('42', 'row_id')}, row_id LIMIT 100")
def subset_sample(fx: Fixtures) -> DataFrame:
    return sampling.subset(fx.rows(), 100).select("row_id", "target")


@query("SELECT item, sid || chr(9) || title || chr(9) || item AS line FROM cat_a")
def info_table(fx: Fixtures) -> DataFrame:
    return C.info_table(fx.catalog())


_VOCAB = "SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(sid, '<[abc]_[0-9]+>')) AS token FROM cat_a JOIN (SELECT target AS item FROM train UNION ALL SELECT unnest(hist) FROM train) USING (item))"


def _sid_examples(fx: Fixtures, split: str) -> DataFrame:
    return predictor.sid_examples(fx.rows(split), fx.catalog())


@query(f"SELECT token, id FROM ({_VOCAB}) UNION ALL SELECT '<pad>', 0")
def vocabulary(fx: Fixtures) -> DataFrame:
    return predictor.vocabulary(_sid_examples(fx, "train"))


@query(f"""WITH v AS (SELECT map_from_entries(list((token, id))) AS v FROM ({_VOCAB})),
    m AS (SELECT map_from_entries(list((item, array_to_string(list_transform(regexp_extract_all(sid, '<[abc]_[0-9]+>'), lambda t: v[t]), ' ')))) AS m FROM cat_a, v)
    SELECT row_id, 10 AS width, repeat('0 0 0 ', 10 - len(hist)) || array_to_string(list_transform(hist, lambda i: m[i]), ' ') AS history, m[target] AS target FROM test, m""")
def encode_examples(fx: Fixtures) -> DataFrame:
    e = predictor.encoded(_sid_examples(fx, "test"), predictor.vocabulary(_sid_examples(fx, "train")), width=10)
    text = lambda a: F.array_join(a.cast("array<string>"), " ")
    return e.where("error IS NULL").select("row_id", F.size("history").alias("width"), text(F.flatten("history")).alias("history"), text(F.col("target")).alias("target"))


# ---------------------------------------------------------------- catalog


@query("SELECT sid, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM cat_a GROUP BY 1")
def decode_table(fx: Fixtures) -> DataFrame:
    return C.decode_table(fx.catalog()).select("sid", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n_items")


@query("SELECT sid, count(*) AS n_items, min(item) AS first_item FROM cat_a GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 3 LIMIT 20")
def collision_groups(fx: Fixtures) -> DataFrame:
    return C.collision_groups(fx.catalog())


_CODES = "SELECT item, level, CAST(regexp_extract(sid, '<' || level || '_([0-9]+)>', 1) AS INT) AS code FROM cat_a, (VALUES ('a'), ('b'), ('c')) v(level)"


@query(f"""WITH n AS (SELECT level, code, count(*) AS c FROM ({_CODES}) GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY level) AS p FROM n)
    SELECT level, count(*) AS distinct_codes, round(count(*) / 256, 6) AS fraction, round(-sum(p * ln(p)), 6) AS entropy, round(ln(count(*)), 6) AS max_entropy, 256 - count(*) FILTER (code BETWEEN 0 AND 255) AS unused FROM p GROUP BY 1""")
def codebook_usage(fx: Fixtures) -> DataFrame:
    return C.codebook_usage(fx.catalog())


@query(f"SELECT level, rnk, code, n FROM (SELECT level, code, count(*) AS n, row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, min(item)) AS rnk FROM ({_CODES}) GROUP BY 1, 2) WHERE rnk <= 8")
def codebook_top(fx: Fixtures) -> DataFrame:
    return C.codebook_top(fx.catalog())


@query(f"SELECT level, rnk, code FROM (SELECT level, code, row_number() OVER (PARTITION BY level ORDER BY code) AS rnk FROM (SELECT level, CAST(code AS INT) AS code FROM range(256) r(code), (VALUES ('a'), ('b'), ('c')) v(level) EXCEPT SELECT level, code FROM ({_CODES}))) WHERE rnk <= 10")
def codebook_unused(fx: Fixtures) -> DataFrame:
    return C.unused_codes(fx.catalog())


@query("""SELECT *, round(unique_sids / items, 6) AS unique_fraction, round(collision_items / items, 6) AS collision_fraction FROM (SELECT sum(n_items) AS items, count(*) AS unique_sids, count(*) FILTER (n_items > 1) AS collision_groups,
    coalesce(sum(n_items) FILTER (n_items > 1), 0) AS collision_items, max(n_items) AS max_group FROM grp_a)""")
def sid_space(fx: Fixtures) -> DataFrame:
    return C.sid_space(fx.catalog())


@query("SELECT sum(n) AS n_rows, count(*) AS unique_sids, sum(n - 1) AS duplicate_rows FROM (SELECT sid, count(*) AS n FROM cat_a GROUP BY 1)")
def info_stats(fx: Fixtures) -> DataFrame:
    return C.info_stats(fx.catalog().select("sid"))


@query("SELECT count(*) AS n_rows, count(DISTINCT target) AS distinct_targets, count(*) FILTER (c.item IS NULL) AS missing_targets, count(*) FILTER (list_contains(hist, target)) AS repeat_rows, min(len(hist)) AS hist_min, max(len(hist)) AS hist_max, round(avg(len(hist)), 6) AS hist_mean FROM test LEFT JOIN cat_a c ON c.item = target")
def test_set_stats(fx: Fixtures) -> DataFrame:
    return C.test_set_stats(fx.rows(), fx.catalog())


@query("SELECT sid, n_items, n_keys FROM grp_a WHERE n_keys > 1")
def ambiguous_sids(fx: Fixtures) -> DataFrame:
    return C.sid_groups(fx.catalog()).where("n_keys > 1")


# ---------------------------------------------------------------- metrics


@query("""WITH s AS (SELECT row_id, unnest(predict) AS sid, unnest(range(50)) AS pos FROM faulty)
    SELECT * FROM (SELECT count(*) AS n_rows, sum(len(predict) - len(list_distinct(predict))) AS duplicates, count(*) FILTER (len(predict) > len(list_distinct(predict))) AS rows_with_duplicates, '50' AS beam_sizes FROM faulty),
    (SELECT count(*) AS n_predictions, count(*) FILTER (sid NOT IN (SELECT sid FROM cat_a)) AS illegal_sids, count(*) FILTER (len(regexp_extract_all(sid, '<[abc]_[0-9]+>')) <> 3) AS wrong_length, count(*) FILTER (sid = '') AS empty_predictions FROM s),
    (SELECT count(*) AS illegal_tokens FROM (SELECT DISTINCT row_id, pos FROM (SELECT row_id, pos, unnest(regexp_extract_all(sid, '<[abc]_[0-9]+>')) AS token FROM s) WHERE token NOT IN (SELECT unnest(regexp_extract_all(sid, '<[abc]_[0-9]+>')) FROM cat_a)))""")
def prediction_audit(fx: Fixtures) -> DataFrame:
    return metrics.audit(fx.beam(faults=True), fx.catalog())


@query("SELECT coalesce(x.u, y.u) AS row_id, x.target AS a, y.target AS b FROM test x FULL JOIN valid y ON x.u = y.u WHERE x.target IS DISTINCT FROM y.target")
def split_order(fx: Fixtures) -> DataFrame:
    of = lambda split: fx.rows(split).select(F.col("u").alias("row_id"), "target")
    return metrics.order_mismatches(of("test"), of("valid"))


@query("SELECT row_id, pos, sid FROM (SELECT row_id, unnest(predict) AS sid, unnest(range(50)) AS pos FROM faulty) WHERE sid NOT IN (SELECT sid FROM cat_a) ORDER BY 1, 2 LIMIT 10")
def illegal_examples(fx: Fixtures) -> DataFrame:
    return metrics.illegal_examples(fx.beam(faults=True), fx.catalog())


@query("""WITH r AS (SELECT list_position(predict, output) - 1 AS p FROM beam_test42a)
    SELECT k, count(*) AS n_rows, count(*) FILTER (p < k) AS hits, round(avg(CASE WHEN p < k THEN 1.0 ELSE 0.0 END), 6) AS hr, round(avg(CASE WHEN p < k THEN ln(2) / ln(p + 2) ELSE 0.0 END), 6) AS ndcg FROM r, (VALUES (1), (3), (5), (10), (20), (50)) v(k) GROUP BY 1""")
def hr_ndcg_at_k(fx: Fixtures) -> DataFrame:
    return metrics.hr_ndcg(fx.beam())


def _rates_sql(pos: str, name: str) -> str:
    return f"count({pos}) AS {name}_hits, round(avg(CASE WHEN {pos} IS NULL THEN 0.0 ELSE 1.0 END), 6) AS {name}_hr, round(avg(CASE WHEN {pos} IS NULL THEN 0.0 ELSE ln(2) / ln({pos} + 2) END), 6) AS {name}_ndcg"


@query(f"""WITH b AS (SELECT 'all' AS bucket, * FROM hits10_test42a UNION ALL SELECT CASE WHEN unique_target THEN 'unique_target' ELSE 'shared_target' END, * FROM hits10_test42a)
    SELECT bucket, count(*) AS n_rows, {_rates_sql('code_pos', 'code')}, {_rates_sql('strict_pos', 'strict')}, round(avg(fraction), 6) AS fraction FROM b GROUP BY 1""")
def item_level_eval(fx: Fixtures) -> DataFrame:
    return metrics.item_level(fx.beam(), fx.catalog())


@query(f"""WITH b AS (SELECT 'all' AS bucket, * FROM hits10_test42a UNION ALL SELECT CASE WHEN ambiguous_target THEN 'ambiguous_target' ELSE 'unambiguous_target' END, * FROM hits10_test42a)
    SELECT bucket, count(*) AS n_rows, {_rates_sql('product_pos', 'product')}, round(avg(product_fraction), 6) AS fraction FROM b GROUP BY 1""")
def product_level_eval(fx: Fixtures) -> DataFrame:
    return metrics.product_level(fx.beam(), fx.catalog())


def _hits(fx: Fixtures, seed: int, catalog: DataFrame, protocol: str) -> DataFrame:
    return metrics.hit_columns(fx.beam(seed, catalog), catalog, protocols=[protocol]).select("row_id", F.col(protocol).alias("hit"))


def _pair_sql(a: str, b: str, pos: str) -> str:
    return f"SELECT x.row_id, CAST(x.{pos} IS NOT NULL AS INT) AS a, CAST(y.{pos} IS NOT NULL AS INT) AS b FROM {a} x JOIN {b} y USING (row_id)"


_TABLE_SQL = "count(*) AS n_rows, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 1 AND b = 1) AS both_hit, count(*) FILTER (a = 0 AND b = 0) AS neither, sum(b - a) AS net, round(avg(a), 6) AS hr_a, round(avg(b), 6) AS hr_b"


@query(f"SELECT {_TABLE_SQL} FROM ({_pair_sql('hits10_test42a', 'hits10_test43a', 'code_pos')})")
def paired_hits(fx: Fixtures) -> DataFrame:
    c = fx.catalog()
    return metrics.paired_table(metrics.paired(_hits(fx, 42, c, "code"), _hits(fx, 43, c, "code")))


@query(f"SELECT {_TABLE_SQL} FROM ({_pair_sql('hits10_test42a', 'hits10_test42b', 'strict_pos')})")
def item_pair_compare(fx: Fixtures) -> DataFrame:
    return metrics.paired_table(metrics.paired(_hits(fx, 42, fx.catalog(), "strict"), _hits(fx, 42, fx.catalog_b(), "strict")))


@query(f"""WITH r AS (SELECT x.target, x.code_pos AS pa, y.code_pos AS pb, EXISTS (SELECT 1 FROM enr_a e WHERE e.item = x.target AND n_items > 1) OR EXISTS (SELECT 1 FROM enr_b e WHERE e.item = x.target AND n_items > 1) AS shared FROM hits10_test42a x JOIN hits10_test42b y USING (row_id)),
    s AS (SELECT 'all' AS subset, * FROM r UNION ALL SELECT CASE WHEN shared THEN 'collision' ELSE 'clean' END, * FROM r) SELECT subset, count(*) AS n_rows, {_rates_sql('pa', 'a')}, {_rates_sql('pb', 'b')} FROM s GROUP BY 1""")
def collision_confound(fx: Fixtures) -> DataFrame:
    a, b = fx.catalog(), fx.catalog_b()
    return metrics.collision_confound(fx.beam(42, a), fx.beam(42, b), a, b)


def _bootstrap_sql(before: str, seed: int, weight: str = "1", names: str = "''") -> str:
    """The report of sets of p (s, d): the sum of d over that of a weight, in draws of as many rows as a set has. names: the sets' names."""
    return f"""WITH RECURSIVE {before}, pg AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY d{", size" * (weight != "1")}) - 1 AS idx, d, {weight} AS w, count(*) AS n FROM p GROUP BY s, d, {weight}),
    pm AS (SELECT s, count(*) AS draws, CAST(sum({weight}) AS BIGINT) AS n_rows, sum(d) / sum({weight}) AS diff FROM p GROUP BY s),
    pp AS (SELECT g AS round, 0 AS stream, s, draws FROM pm, range({ROUNDS}) r(g)),
    {oracles.splitting_tree("tr", seed, "pg", "pp")},
    pv AS (SELECT s, round, sum(tr.n * d) / sum(tr.n * w) AS v FROM tr JOIN pg USING (s, idx) GROUP BY s, round),
    pi AS (SELECT s, {_INTERVAL} FROM (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY v) - 1 AS r FROM pv) GROUP BY s)
    SELECT {names} AS subset, {_REPORT} FROM pm JOIN pi USING (s)"""


_COLLISIONS = f"""cr AS (SELECT row_id, CAST(coalesce(x.code_pos < 10, false) AS INT) AS a, CAST(coalesce(y.code_pos < 10, false) AS INT) AS b, EXISTS (SELECT 1 FROM enr_a e WHERE e.item = x.target AND n_items > 1) OR EXISTS (SELECT 1 FROM enr_b e WHERE e.item = x.target AND n_items > 1) AS shared FROM hits10_test42a x JOIN hits10_test42b y USING (row_id)),
    p AS (SELECT list_position({list(diagnose.SUBSETS)}, subset) - 1 AS s, b - a AS d FROM (SELECT 'all' AS subset, * FROM cr UNION ALL SELECT CASE WHEN shared THEN 'collision' ELSE 'clean' END, * FROM cr))"""


@query(_bootstrap_sql(_COLLISIONS, 42, names=f"{list(diagnose.SUBSETS)}[s + 1]"))
def collision_intervals(fx: Fixtures) -> DataFrame:
    a, b = fx.catalog(), fx.catalog_b()
    fx.beams(42)
    return resample.subset_bootstraps(diagnose.hits_of(metrics.collision_rows(fx.beam(42, a), fx.beam(42, b), a, b)), diagnose.SUBSETS, ROUNDS)


@query("SELECT count(*) AS n_rows, count(code_pos) AS in_beam, count(strict_pos) AS strict_in_beam, round(count(code_pos) / count(*), 6) AS code_ceiling, round(count(strict_pos) / count(*), 6) AS strict_ceiling FROM hits50_test42a")
def reachability(fx: Fixtures) -> DataFrame:
    return metrics.reachability(fx.beam(), fx.catalog())


# ---------------------------------------------------------------- resampling



def _pairs(fx: Fixtures) -> DataFrame:
    c = fx.catalog()
    return written(metrics.paired(_hits(fx, 42, c, "code"), _hits(fx, 43, c, "code")))


def _alone(sql: str) -> str:
    return sql.replace("SELECT '' AS subset, ", "SELECT ")


@query(_alone(_bootstrap_sql(f"p AS (SELECT 0 AS s, b - a AS d FROM ({_pair_sql('hits10_test42a', 'hits10_test43a', 'code_pos')}))", 42)))
def paired_bootstrap(fx: Fixtures) -> DataFrame:
    return resample.paired_bootstrap(_pairs(fx), ROUNDS)


@query(_alone(_bootstrap_sql(f"p AS (SELECT 0 AS s, sum(b - a) AS d, count(*) AS size FROM ({_pair_sql('hits10_test42a', 'hits10_test43a', 'code_pos')}) JOIN customer ON c_custkey = row_id // 100000 GROUP BY c_nationkey)", 17, "size")))
def cluster_bootstrap(fx: Fixtures) -> DataFrame:
    users = fx.table("customer").select(F.col("c_custkey").alias("u"), F.col("c_nationkey").alias("cluster"))
    return resample.cluster_bootstrap(_pairs(fx).withColumn("u", F.floor(F.col("row_id") / 100000)).join(users, "u"), ROUNDS)


def _seed_pairs(fx: Fixtures, protocol: str) -> DataFrame:
    a, b, out = fx.catalog(), fx.catalog_b(), None
    fx.beams(42, 43, 44)
    for i, seed in enumerate((42, 43, 44)):
        p = metrics.paired(_hits(fx, seed, a, protocol), _hits(fx, seed, b, protocol)).select(F.lit(i).alias("sidx"), "*")
        out = p if out is None else out.union(p)
    return out


def _seeds_sql(pos: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS sidx, * FROM ({_pair_sql(f'hits10_test{s}a', f'hits10_test{s}b', pos)})" for i, s in enumerate((42, 43, 44)))


def _two_stage_sql(pairs: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT sidx AS s, b - a AS d FROM ({pairs})), pm AS (SELECT count(*) AS n_rows, avg(d) AS diff FROM p),
    pg AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY d) - 1 AS idx, d, count(*) AS n FROM p GROUP BY s, d),
    pp AS (SELECT g AS round, x AS stream, {oracles.u32('7', 'g', "'s'", 'x')} % 3 AS s, n_rows // 3 AS draws FROM pm, range({ROUNDS}) r(g), range(3) q(x)),
    {oracles.splitting_tree("tr", 7, "pg", "pp")},
    pv AS (SELECT round, sum(tr.n * d) / sum(tr.n) AS v FROM tr JOIN pg USING (s, idx) GROUP BY round)
    SELECT {_REPORT} FROM pm, (SELECT {_INTERVAL} FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM pv))"""


@query(_two_stage_sql(_seeds_sql("strict_pos")))
def two_stage_bootstrap(fx: Fixtures) -> DataFrame:
    return resample.two_stage_bootstrap(written(_seed_pairs(fx, "strict")), ROUNDS)


#: Rows whose target has a SID of its own in both catalogs.
_KEPT_SQL = f"SELECT p.* FROM ({_seeds_sql('strict_pos')}) p JOIN test t ON t.row_id = p.row_id JOIN enr_a x ON x.item = t.target JOIN enr_b y ON y.item = t.target WHERE x.n_items = 1 AND y.n_items = 1"


def _kept_pairs(fx: Fixtures) -> DataFrame:
    return _seed_pairs(fx, "strict").join(metrics.unique_in_both(fx.rows(), fx.catalog(), fx.catalog_b()), "row_id", "left_semi")


@query(_two_stage_sql(_KEPT_SQL))
def two_stage_bootstrap_kept(fx: Fixtures) -> DataFrame:
    return resample.two_stage_bootstrap(written(_kept_pairs(fx)), ROUNDS)


@query(f"SELECT sidx, count(*) AS n_rows, round(avg(a), 6) AS hr_a, round(avg(b), 6) AS hr_b, round(avg(b) - avg(a), 6) AS diff FROM ({_KEPT_SQL}) GROUP BY 1")
def seed_means_kept(fx: Fixtures) -> DataFrame:
    return resample.seed_means(_kept_pairs(fx))


def _summary_sql(pairs: str, same: str) -> str:
    return f"""WITH d AS (SELECT sidx, avg(b) - avg(a) AS diff FROM ({pairs}) GROUP BY 1), s AS (SELECT count(*) AS n_seeds, avg(diff) AS mean, stddev_samp(diff) AS sd, min(diff) AS lo, max(diff) AS hi FROM d), t AS (SELECT *, mean / (nullif(sd, 0) / sqrt(n_seeds)) AS t FROM s)
    SELECT n_seeds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi, round(t, 6) AS t, {same} AS same_sign, n_seeds - 1 AS df, round(1 - abs(t) / sqrt(t * t + 2), 4) AS p FROM t"""


@query(_summary_sql(_KEPT_SQL, "lo > 0"))
def seed_summary_kept(fx: Fixtures) -> DataFrame:
    return resample.seed_summary(_kept_pairs(fx).groupBy("sidx").agg((F.avg("b") - F.avg("a")).alias("diff")))


@query(_summary_sql(_seeds_sql("strict_pos"), "lo > 0"))
def seed_summary(fx: Fixtures) -> DataFrame:
    return resample.seed_summary(_seed_pairs(fx, "strict").groupBy("sidx").agg((F.avg("b") - F.avg("a")).alias("diff")))


@query(_summary_sql(_seeds_sql("product_pos"), "lo > 0 OR hi < 0"))
def seed_summary_product(fx: Fixtures) -> DataFrame:
    return resample.seed_summary(_seed_pairs(fx, "product").groupBy("sidx").agg((F.avg("b") - F.avg("a")).alias("diff")), either_sign=True)


# ---------------------------------------------------------------- diagnostics


@query("""WITH r AS (SELECT b.row_id, b.target, coalesce(n, 0) AS seen, list_contains(predict, output) AS cover, len(list_filter(predict, lambda x: string_split(x, '<b_')[1] = string_split(output, '<b_')[1])) > 0 AS l1, code_pos, strict_pos FROM beam_test42a b JOIN hits10_test42a USING (row_id) LEFT JOIN target_n t ON t.item = b.target),
    k AS (SELECT *, CASE WHEN seen = 0 THEN '0' WHEN seen = 1 THEN '1' WHEN seen <= 5 THEN '2-5' WHEN seen <= 20 THEN '6-20' WHEN seen <= 100 THEN '21-100' ELSE '>100' END AS bucket FROM r),
    u AS (SELECT * FROM k UNION ALL SELECT * REPLACE ('all' AS bucket) FROM k), g AS (SELECT bucket, count(*) AS n_rows, count(code_pos) AS h, count(strict_pos) AS s, count(*) FILTER (cover) AS c, count(*) FILTER (l1) AS l FROM u GROUP BY 1)
    SELECT v.bucket, coalesce(n_rows, 0) AS n_rows, round(coalesce(n_rows, 0) / (SELECT greatest(n_rows, 1) FROM g WHERE bucket = 'all'), 4) AS share, round(coalesce(h, 0) / greatest(coalesce(n_rows, 0), 1), 4) AS hr, round(coalesce(s, 0) / greatest(coalesce(n_rows, 0), 1), 4) AS strict_hr,
    round(coalesce(c, 0) / greatest(coalesce(n_rows, 0), 1), 4) AS coverage, round(coalesce(l, 0) / greatest(coalesce(n_rows, 0), 1), 4) AS level1 FROM (VALUES ('0'), ('1'), ('2-5'), ('6-20'), ('21-100'), ('>100'), ('all')) v(bucket) LEFT JOIN g ON g.bucket = v.bucket""")
def popularity_buckets(fx: Fixtures) -> DataFrame:
    return diagnose.popularity_buckets(fx.beam(), fx.catalog(), fx.rows("train"))


@query("""WITH o AS (SELECT row_id, list(DISTINCT sid) AS own FROM (SELECT row_id, unnest(hist) AS item FROM test) JOIN cat_a USING (item) GROUP BY 1),
    r AS (SELECT len(list_filter(predict, lambda x: list_contains(own, x))) AS slots, list_contains(own, predict[1]) AS copy, list_contains(hist, b.target) AS rep FROM beam_test42a b JOIN test t USING (row_id) JOIN o USING (row_id))
    SELECT count(*) AS n_rows, round(sum(slots) / (count(*) * 50), 6) AS slot_share, round(count(*) FILTER (copy) / count(*), 6) AS copy_first, round(count(*) FILTER (rep) / count(*), 6) AS target_repeat, round(count(*) FILTER (copy AND rep) / count(*) FILTER (copy), 6) AS repeat_of_copy_first FROM r""")
def history_copy(fx: Fixtures) -> DataFrame:
    return diagnose.history_copy(fx.beam(), fx.rows(), fx.catalog())


@query(" UNION ALL ".join(f"SELECT {s} AS seed, CASE WHEN x.unique_target THEN 'unique' ELSE 'shared' END AS subset, count(*) AS n_rows, count(x.strict_pos) AS hits_a, count(y.strict_pos) AS hits_b FROM hits10_test{s}a x JOIN hits10_test{s}b y USING (row_id) GROUP BY 2" for s in (42, 43, 44)))
def shared_rows(fx: Fixtures) -> DataFrame:
    a, b = fx.catalog(), fx.catalog_b()
    fx.beams(42, 43, 44)
    return diagnose.shared_rows({s: (fx.beam(s, a), fx.beam(s, b)) for s in (42, 43, 44)}, a, b)


@query("SELECT n_items, count(DISTINCT target) AS n_targets, count(*) AS n_rows FROM test JOIN enr_a ON item = target GROUP BY 1")
def shared_group_sizes(fx: Fixtures) -> DataFrame:
    return diagnose.shared_group_sizes(fx.rows(), fx.catalog())


@query("SELECT target, n_rows, a.n_items AS group_a, b.n_items AS group_b FROM (SELECT target, count(*) AS n_rows, min(row_id) AS f FROM test GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10) JOIN enr_a a ON a.item = target JOIN enr_b b ON b.item = target")
def top_targets(fx: Fixtures) -> DataFrame:
    return diagnose.top_targets(fx.rows(), fx.catalog(), fx.catalog_b())


_CURVE = """SELECT log, count(*) AS points, round(arg_min(hr10, step), 6) AS start, round(max(hr10), 6) AS best, first(step ORDER BY hr10 DESC, step) AS best_step, round(arg_max(hr10, step), 6) AS final,
    round(max(hr10) - arg_min(hr10, step), 6) AS gain_best, round(arg_max(hr10, step) - arg_min(hr10, step), 6) AS gain_final FROM mlog GROUP BY 1"""


@query(_CURVE)
def metric_curve(fx: Fixtures) -> DataFrame:
    return diagnose.metric_curve(fx.metric_log())


@query(f"SELECT count(*) AS runs, round(avg(start), 6) AS mean_start, round(avg(best), 6) AS mean_best, round(avg(final), 6) AS mean_final, count(*) FILTER (gain_best > 0) AS wins FROM ({_CURVE})")
def curve_summary(fx: Fixtures) -> DataFrame:
    return diagnose.curve_summary(diagnose.metric_curve(fx.metric_log()))


# ---------------------------------------------------------------- SID quality

_STATES = """st AS (SELECT row_id, regexp_extract(l.sid, '^<a_[0-9]+>') AS x, l.sid AS x_full, regexp_extract(t.sid, '^<a_[0-9]+>') AS y FROM train JOIN cat_a t ON t.item = target JOIN cat_a l ON l.item = hist[-1])"""


def _states(fx: Fixtures) -> DataFrame:
    return quality.states(fx.rows("train"), fx.catalog())


@query("""WITH h AS (SELECT row_id, p, count(*) AS c FROM (SELECT row_id, regexp_extract(sid, '^<a_[0-9]+>') AS p FROM (SELECT row_id, unnest(hist) AS item FROM train) JOIN cat_a USING (item)) GROUP BY 1, 2)
    SELECT sum(CAST(n * (n - 1) / 2 AS BIGINT)) AS pairs, sum(same) AS same, round(sum(same) / sum(n * (n - 1) / 2), 6) AS rate FROM (SELECT row_id, sum(c) AS n, sum(CAST(c * (c - 1) / 2 AS BIGINT)) AS same FROM h GROUP BY 1)""")
def co_prefix_rate(fx: Fixtures) -> DataFrame:
    return quality.co_prefix_rate(_states(fx))


@query(f"WITH {_STATES}, n AS (SELECT x_full, max(c) AS best, sum(c) AS n FROM (SELECT x_full, y, count(*) AS c FROM st GROUP BY 1, 2) GROUP BY 1) SELECT count(*) AS states, sum(n) AS n_rows, sum(best) AS correct, round(sum(best) / sum(n), 6) AS accuracy FROM n")
def majority_acc(fx: Fixtures) -> DataFrame:
    return quality.majority_accuracy(_states(fx), "x_full")


@query(f"""WITH {_STATES}, i AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, x, y FROM st), m AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS cut FROM st),
    b AS (SELECT x, y AS guess FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, min(idx)) AS r FROM i, m WHERE idx < cut GROUP BY x, y) WHERE r = 1), o AS (SELECT y AS most FROM i, m WHERE idx < cut GROUP BY y ORDER BY count(*) DESC, min(idx) LIMIT 1)
    SELECT count(*) AS n_rows, count(*) FILTER (coalesce(guess, most) = y) AS correct, round(count(*) FILTER (coalesce(guess, most) = y) / count(*), 6) AS accuracy FROM m, o, i LEFT JOIN b ON b.x = i.x WHERE idx >= cut""")
def heldout_majority(fx: Fixtures) -> DataFrame:
    return quality.heldout_majority(with_index(_states(fx).select("row_id", "x", "y"), "row_id"))


_INFO = f"""WITH {_STATES}, n AS (SELECT x, y, count(*) AS c FROM st GROUP BY 1, 2), t AS (SELECT sum(c) AS t FROM n), hx AS (SELECT -sum(c / t * ln(c / t)) AS h, count(*) AS k FROM (SELECT x, sum(c) AS c FROM n GROUP BY 1), t), hy AS (SELECT -sum(c / t * ln(c / t)) AS h, count(*) AS k FROM (SELECT y, sum(c) AS c FROM n GROUP BY 1), t),
    mi AS (SELECT sum(n.c / t * ln(n.c * t / (a.c * b.c))) AS mi FROM n JOIN (SELECT x, sum(c) AS c FROM n GROUP BY 1) a USING (x) JOIN (SELECT y, sum(c) AS c FROM n GROUP BY 1) b USING (y), t)"""


@query(f"{_INFO} SELECT hx.k AS context_classes, round(mi, 6) AS mi, round(mi / hy.h, 6) AS nmi FROM hx, hy, mi")
def nmi(fx: Fixtures) -> DataFrame:
    return quality.information(_states(fx)).select("context_classes", "mi", "nmi")


@query(f"{_INFO} SELECT round(hy.h, 4) AS target_entropy, hy.k AS target_classes FROM hy")
def target_entropy(fx: Fixtures) -> DataFrame:
    return quality.information(_states(fx)).select("target_entropy", "target_classes")


_L1 = "regexp_extract({}, '^<a_[0-9]+>')"


@query(f"""WITH h AS (SELECT row_id, pos, n.sid FROM (SELECT row_id, p.pos, hist[p.pos + 1] AS item FROM train, range(10) AS p(pos) WHERE p.pos < len(hist)) JOIN {_NEW} n USING (item)),
    l AS (SELECT row_id, arg_max(sid, pos) AS x_full FROM h GROUP BY 1), st AS (SELECT row_id, x_full, t.sid AS y_full, {_L1.format("x_full")} AS x, {_L1.format("t.sid")} AS y FROM train JOIN l USING (row_id) JOIN {_NEW} t ON t.item = target),
    co AS (SELECT count(*) AS co_prefix_pairs, round(count(*) FILTER ({_L1.format("a.sid")} = {_L1.format("b.sid")}) / count(*), 6) AS co_prefix_pair_rate FROM st JOIN h a USING (row_id) JOIN h b ON b.row_id = a.row_id AND a.pos < b.pos),
    ml AS (SELECT round(sum(b) / sum(n), 6) AS majority_acc_level FROM (SELECT x, max(c) AS b, sum(c) AS n FROM (SELECT x, y, count(*) AS c FROM st GROUP BY 1, 2) GROUP BY 1)),
    mf AS (SELECT round(sum(b) / sum(n), 6) AS majority_acc_full FROM (SELECT x_full, max(c) AS b, sum(c) AS n FROM (SELECT x_full, y, count(*) AS c FROM st GROUP BY 1, 2) GROUP BY 1)),
    i AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, x, y FROM st), cut AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS cut FROM st),
    best AS (SELECT x, y AS guess FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, min(idx)) AS r FROM i, cut WHERE idx < cut GROUP BY x, y) WHERE r = 1), o AS (SELECT y AS most FROM i, cut WHERE idx < cut GROUP BY y ORDER BY count(*) DESC, min(idx) LIMIT 1),
    held AS (SELECT round(count(*) FILTER (coalesce(guess, most) = y) / count(*), 6) AS heldout_acc_level FROM cut, o, i LEFT JOIN best ON best.x = i.x WHERE idx >= cut),
    t AS (SELECT count(*) AS used_rows, count(DISTINCT y_full) AS target_full_classes, count(DISTINCT x_full) AS context_states, count(DISTINCT y) AS target_classes FROM st),
    hy AS (SELECT -sum(c / used_rows * ln(c / used_rows)) AS h FROM (SELECT y, count(*) AS c FROM st GROUP BY 1), t), px AS (SELECT x, count(*) AS c FROM st GROUP BY 1), py AS (SELECT y, count(*) AS c FROM st GROUP BY 1),
    mi AS (SELECT sum(n.c / used_rows * ln(n.c * used_rows / (px.c * py.c))) AS mi FROM (SELECT x, y, count(*) AS c FROM st GROUP BY 1, 2) n JOIN px USING (x) JOIN py USING (y), t)
    SELECT (SELECT count(*) FROM train) AS n_rows, t.*, co.*, ml.*, mf.*, held.*, round(mi / h, 6) AS nmi, round(h, 4) AS target_entropy FROM t, co, ml, mf, held, hy, mi""")
def quality_report(fx: Fixtures) -> DataFrame:
    rows = fx.rows("train")
    return quality.report(rows, written(quality.states(rows, _new_index(fx)), "states"))


@query("""WITH u AS (SELECT row_id, list_distinct(hist) AS items FROM train WHERE len(list_distinct(hist)) >= 5), e AS (SELECT row_id, unnest(items) AS item FROM u), n AS (SELECT item, count(*) AS n FROM e GROUP BY 1),
    p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM e x JOIN e y ON x.row_id = y.row_id AND x.item < y.item GROUP BY 1, 2), t AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM p)
    SELECT a, b, c, ppmi FROM (SELECT a, b, c, round(ln(c * t / (x.n * CAST(y.n AS DOUBLE))), 9) AS ppmi FROM p JOIN n x ON x.item = a JOIN n y ON y.item = b, t) WHERE ppmi > 0""")
def ppmi_support(fx: Fixtures) -> DataFrame:
    return cooc.ppmi(fx.rows("train"), min_history=5)


#: Drawn pairs of titles, the operator's default.
_PAIRS = 100000


def _titles(kind: str) -> str:
    return oracles.u32("42", "i", f"'{kind}'")


@query("""WITH t AS (SELECT regexp_extract(sid, '^<a_[0-9]+>') AS p, list_sort(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS k, item FROM cat_a),
    j AS (SELECT a.p = b.p AS same, CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END AS j FROM t a JOIN t b ON a.item < b.item)
    SELECT count(*) FILTER (same) AS within_pairs, count(*) FILTER (NOT same) AS across_pairs, round(avg(j) FILTER (same), 6) AS within, round(avg(j) FILTER (NOT same), 6) AS across, round(avg(j) FILTER (same) - avg(j) FILTER (NOT same), 6) AS gain FROM j""")
def title_coherence(fx: Fixtures) -> DataFrame:
    return quality.title_coherence(fx.catalog())


# ---------------------------------------------------------------- co-occurrence


@query(f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY p, item) - 1 AS idx, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS tokens FROM (SELECT item, title, regexp_extract(sid, '^<a_[0-9]+>') AS p FROM cat_a)),
    g AS (SELECT p, min(idx) AS head, count(*) AS n FROM t GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS k FROM g WHERE n > 1),
    m AS (SELECT (SELECT count(*) FROM k) AS n_keys, sum(n) AS n_all, CAST(ceil({_PAIRS} / (1 - sum(n * n) / (sum(n) * sum(n))) * 1.2) AS BIGINT) + 100 AS tries FROM g),
    i1 AS (SELECT i, k.*, {_titles('a')} % n AS first FROM (SELECT i, {_titles('k')} % n_keys AS k FROM range({_PAIRS}) r(i), m) JOIN k USING (k)),
    i2 AS (SELECT i, n_all AS n, {_titles('x')} % n_all AS first FROM m, range(200000) r(i) WHERE i < tries),
    d AS (SELECT i, true AS same, head + first AS a, head + (first + 1 + {_titles('b')} % (n - 1)) % n AS b FROM i1 UNION ALL SELECT i, false, first, (first + 1 + {_titles('b')} % (n - 1)) % n FROM i2),
    j AS (SELECT i, same, CASE WHEN len(x.tokens) = 0 OR len(y.tokens) = 0 THEN 0.0 ELSE len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens))) END AS j FROM d JOIN t x ON x.idx = a JOIN t y ON y.idx = b WHERE same OR x.p <> y.p),
    f AS (SELECT same, j FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY i) AS r FROM j) WHERE r <= {_PAIRS})
    SELECT count(*) FILTER (same) AS within_pairs, count(*) FILTER (NOT same) AS across_pairs, round(avg(j) FILTER (same), 6) AS within, round(avg(j) FILTER (NOT same), 6) AS across, round(avg(j) FILTER (same) - avg(j) FILTER (NOT same), 6) AS gain FROM f""")
def title_coherence_sampled(fx: Fixtures) -> DataFrame:
    return quality.sampled_title_coherence(fx.catalog(), n_pairs=_PAIRS)


@query("SELECT a, b, c FROM pairs")
def pair_counts(fx: Fixtures) -> DataFrame:
    return cooc.pair_counts(fx.rows("train"))


@query("SELECT a, b, c, ppmi FROM pmi")
def ppmi(fx: Fixtures) -> DataFrame:
    return cooc.ppmi(fx.rows("train"))


@query("SELECT item, other, rnk FROM adj WHERE rnk <= 20")
def adjacency_topk(fx: Fixtures) -> DataFrame:
    return cooc.nearest(fx.rows("train"), 20).select("item", "other", "rnk")


@query("SELECT level, code, n FROM lev")
def level_priors(fx: Fixtures) -> DataFrame:
    return cooc.level_priors(fx.rows("train"), fx.catalog())


@query("SELECT item, n, rnk FROM popular WHERE rnk <= 60")
def popular_items(fx: Fixtures) -> DataFrame:
    return cooc.popular(fx.rows("train"))


@query("SELECT row_id, item, score, rnk FROM prior WHERE rnk <= 10")
def prior_ranks(fx: Fixtures) -> DataFrame:
    return cooc.best_priors(fx.rows(), cooc.History(fx.rows("train")), 10)


@query("""WITH best AS (SELECT row_id, sid, min(rnk) AS rnk FROM prior JOIN cat_a USING (item) WHERE rnk <= 500 GROUP BY 1, 2), r AS (SELECT list_contains(predict, output) AS inb, rnk FROM beam_test42a b LEFT JOIN best ON best.row_id = b.row_id AND best.sid = b.output)
    SELECT size, count(*) AS n_rows, count(*) FILTER (rnk <= size) AS pool_hits, count(*) FILTER (coalesce(rnk <= size, false) OR inb) AS union_hits FROM r, (VALUES (10), (20), (50), (100), (200), (500)) v(size) GROUP BY 1""")
def cooc_recall_ceiling(fx: Fixtures) -> DataFrame:
    return cooc.recall_ceiling(fx.rows(), cooc.History(fx.rows("train")), fx.beam(), fx.catalog())


@query("""WITH near AS (SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, item) AS place FROM (SELECT row_id, other AS item, max(ppmi) AS v FROM (SELECT row_id, unnest(list_distinct(hist)) AS item FROM test) JOIN adj USING (item) WHERE rnk <= 200 GROUP BY 1, 2)), top AS (SELECT * FROM near WHERE place <= 60)
    SELECT row_id, item, place FROM top UNION ALL SELECT t.row_id, p.item, 60 + p.rnk FROM test t, popular p WHERE p.rnk <= 40 AND NOT EXISTS (SELECT 1 FROM top WHERE top.row_id = t.row_id AND top.item = p.item)""")
def beamlike_pool(fx: Fixtures) -> DataFrame:
    train = fx.rows("train")
    return cooc.beamlike_pool(fx.rows(), cooc.History(train), train)


# ---------------------------------------------------------------- reranking


@query("""WITH h AS (SELECT row_id, list_filter(hist, lambda x: x <> target) AS hist FROM test), u AS (SELECT row_id, unnest(list_distinct(hist)) AS other FROM h), s AS (SELECT d.row_id, d.sid, c.item, coalesce(sum(ppmi), 0) AS v FROM dist d JOIN cat_a c USING (sid) LEFT JOIN (SELECT u.row_id, y.item, y.ppmi FROM u JOIN sym y USING (other)) z ON z.row_id = d.row_id AND z.item = c.item GROUP BY 1, 2, 3),
    b AS (SELECT row_id, sid, round(max(v), 9) AS score FROM s GROUP BY 1, 2)
    SELECT row_id, sid, rank, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, rank) - 1 AS new_rank FROM dist JOIN b USING (row_id, sid) WHERE row_id IN (SELECT row_id FROM h WHERE len(hist) > 0)""")
def rerank_cooc(fx: Fixtures) -> DataFrame:
    return rank.by_cooccurrence(fx.beam(), fx.rows(), fx.rows("train"), fx.catalog())


@query("WITH t AS (SELECT sid, max(n) AS score FROM cat_a JOIN target_n USING (item) GROUP BY 1) SELECT row_id, d.sid, rank, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(score, 0) DESC, rank) - 1 AS new_rank FROM dist d LEFT JOIN t USING (sid)")
def rerank_popularity(fx: Fixtures) -> DataFrame:
    return rank.by_popularity(fx.beam(), fx.rows("train"), fx.catalog()).select("row_id", "sid", "rank", "score", "new_rank")


@query("""WITH t AS (SELECT sid, max(n) AS score FROM cat_a JOIN target_n USING (item) GROUP BY 1), p AS (SELECT row_id, d.sid, rank, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(score, 0) DESC, rank) - 1 AS new_rank FROM dist d LEFT JOIN t USING (sid))
    SELECT row_id, sid, rank, new_rank, row_number() OVER (PARTITION BY row_id ORDER BY round(1 / (11 + rank) + 1.0 / (11 + new_rank), 9) DESC, rank) - 1 AS fused_rank FROM p""")
def rrf_fusion(fx: Fixtures) -> DataFrame:
    return rank.fused(rank.by_popularity(fx.beam(), fx.rows("train"), fx.catalog())).select("row_id", "sid", "rank", "new_rank", "fused_rank")


@query("""WITH h AS (SELECT row_id, list(m ORDER BY i) AS hv FROM (SELECT row_id, i, avg(v) AS m FROM (SELECT row_id, unnest(CAST(vec AS DOUBLE[])) AS v, unnest(range(len(vec))) AS i FROM (SELECT row_id, unnest(hist) AS item FROM test) JOIN vecs USING (item)) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT d.row_id, d.sid, round(max(list_cosine_similarity(CAST(vec AS DOUBLE[]), hv)), 6) AS score FROM dist d JOIN cat_a USING (sid) JOIN vecs USING (item) JOIN h ON h.row_id = d.row_id GROUP BY 1, 2)
    SELECT row_id, sid, rank, score FROM dist JOIN s USING (row_id, sid)""")
def rerank_similarity(fx: Fixtures) -> DataFrame:
    return rank.by_similarity(fx.beam(), fx.rows(), fx.vectors(), fx.catalog()).select("row_id", "sid", "rank", "score")


_ROUNDED = ", ".join(f"round({n}, 5) AS {n}" for n in features.POINTWISE)


def _stats(fx: Fixtures) -> features.Stats:
    return features.Stats(fx.rows("train"), fx.catalog())


def _by_sid(fx: Fixtures, split: str = "test") -> DataFrame:
    return written(features.by_sid(fx.beam(split=split), fx.rows(split), _stats(fx)), "features")


@query(f"SELECT row_id, sid, rank, {_ROUNDED} FROM feat")
def pointwise_features(fx: Fixtures) -> DataFrame:
    return _by_sid(fx).select("row_id", "sid", "rank", *[F.round(n, 5).alias(n) for n in features.POINTWISE])


_SCORED = f"(SELECT row_id, sid, rank, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, rank) - 1 AS new_rank FROM (SELECT *, round({linear_sql(MODEL)}, 6) AS score FROM feat))"


@query(f"SELECT row_id, sid, rank, score FROM {_SCORED}")
def pointwise_score(fx: Fixtures) -> DataFrame:
    return learn.scored(_by_sid(fx), MODEL).select("row_id", "sid", "rank", "score")


@query(f"SELECT row_id, sid, rank, row_number() OVER (PARTITION BY row_id ORDER BY round(1 / (11 + rank) + 1.0 / (11 + new_rank), 9) DESC, rank) - 1 AS fused_rank FROM {_SCORED}")
def fused_orders(fx: Fixtures) -> DataFrame:
    return rank.fused(learn.scored(_by_sid(fx), MODEL)).select("row_id", "sid", "rank", "fused_rank")


_FRESH = "(SELECT DISTINCT row_id, other AS item FROM (SELECT row_id, unnest(list_distinct(hist)) AS item FROM test) JOIN adj USING (item) WHERE rnk <= 3000)"


_AUGMENTED = f"""fresh AS (SELECT f.row_id, f.item FROM {_FRESH} f JOIN cat_a c USING (item) WHERE NOT EXISTS (SELECT 1 FROM dist WHERE dist.row_id = f.row_id AND dist.sid = c.sid)), x AS (SELECT *, round({linear_sql(MODEL)}, 6) AS score FROM ({oracles.features('fresh', 'test')})),
    o AS (SELECT row_id, sid, item, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id, sid ORDER BY score DESC, item) AS r FROM x) WHERE r = 1),
    au AS (SELECT row_id, sid, item, score, place FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item) AS place FROM o) WHERE place <= 5)"""


@query(f"WITH {_AUGMENTED} SELECT * FROM au")
def augment_candidates(fx: Fixtures) -> DataFrame:
    return rank.augmented(fx.beam(), fx.rows(), _stats(fx), MODEL, 5)


@query(f"""WITH {_AUGMENTED}, r AS (SELECT b.row_id, e.n_items, list_contains(b.predict, b.output) OR EXISTS (SELECT 1 FROM au WHERE au.row_id = b.row_id AND au.sid = b.output) AS held FROM beam_test42a b JOIN enr_a e ON e.item = b.target)
    SELECT count(*) AS n_rows, count(*) FILTER (held) AS in_beam, count(*) FILTER (held AND n_items = 1) AS strict_in_beam, round(count(*) FILTER (held) / count(*), 6) AS code_ceiling, round(count(*) FILTER (held AND n_items = 1) / count(*), 6) AS strict_ceiling FROM r""")
def reachability_augmented(fx: Fixtures) -> DataFrame:
    beam, c, st = fx.beam(), fx.catalog(), _stats(fx)
    added = rank.augmented(beam, fx.rows(), st, MODEL, 5)
    # In the base order what is added follows the beam, whatever the beam's own scores.
    return metrics.reachability(rank.extended(beam, added), c)


_LIST = f"""n_items AS (SELECT row_id, count(*) AS n FROM prior GROUP BY 1), pop_item AS (SELECT item, row_number() OVER (ORDER BY item) AS pop FROM cat_a), pop_code AS (SELECT code, row_number() OVER (ORDER BY k DESC, f) AS pop FROM (SELECT l1 AS code, count(*) AS k, min(row_id) AS f FROM train JOIN enr_a ON item = target GROUP BY 1)),
    lp AS (SELECT *, row_number() OVER (PARTITION BY row_id, level ORDER BY score DESC, code) AS rnk FROM (SELECT row_id, level, code, round(sum(score), 9) AS score FROM (SELECT row_id, score, 1 AS level, l1 AS code FROM prior JOIN enr_a USING (item) UNION ALL SELECT row_id, score, 2, l2 FROM prior JOIN enr_a USING (item)) GROUP BY 1, 2, 3)),
    nl AS (SELECT row_id, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2 FROM lp GROUP BY 1),
    it AS (SELECT d.row_id, d.sid, min(coalesce(p.rnk, coalesce(n_items.n, 0) + coalesce(pop, 9999))) AS ir FROM dist d JOIN cat_a c USING (sid) LEFT JOIN prior p ON p.row_id = d.row_id AND p.item = c.item LEFT JOIN n_items ON n_items.row_id = d.row_id LEFT JOIN pop_item ON pop_item.item = c.item GROUP BY 1, 2),
    sl AS (SELECT DISTINCT sid, l1, l2 FROM enr_a), br AS (SELECT row_id, sid, count(*) OVER (PARTITION BY row_id, substr(sid, 1, 7)) AS s1, count(*) OVER (PARTITION BY row_id, substr(sid, 1, 14)) AS s2 FROM dist),
    lf AS (SELECT f.*, CAST(f.sid = b.output AS INT) AS label, ln(2 + f.rank) AS rank_model, CAST(f.rank = 0 AS INT) AS is_top1, ln(1 + ir) AS prior_item_rank_log, ln(1 + coalesce(p1.rnk, coalesce(n1, 0) + coalesce(c1.pop, 999))) AS prior_l1_rank_log, ln(1 + coalesce(p2.rnk, coalesce(n2, 0) + coalesce(c2.pop, 999))) AS prior_l2_rank_log, s1 AS branch_l1_slots, s2 AS branch_l2_slots
      FROM feat f JOIN sl USING (sid) JOIN it ON it.row_id = f.row_id AND it.sid = f.sid JOIN br ON br.row_id = f.row_id AND br.sid = f.sid JOIN beam_test42a b ON b.row_id = f.row_id LEFT JOIN nl ON nl.row_id = f.row_id LEFT JOIN lp p1 ON p1.row_id = f.row_id AND p1.level = 1 AND p1.code = l1 LEFT JOIN lp p2 ON p2.row_id = f.row_id AND p2.level = 2 AND p2.code = l2 LEFT JOIN pop_code c1 ON c1.code = l1 LEFT JOIN pop_code c2 ON c2.code = substr(l2, 1, 1))"""
_EXTRA = features.LISTWISE[len(features.POINTWISE) :]


def _listwise(fx: Fixtures) -> DataFrame:
    return written(features.listwise(fx.beam(), fx.rows(), _stats(fx)), "listwise")


@query(f"WITH {_LIST} SELECT row_id, sid, rank, label, {', '.join(f'round({n}, 5) AS {n}' for n in _EXTRA)} FROM lf")
def listwise_features(fx: Fixtures) -> DataFrame:
    return _listwise(fx).select("row_id", "sid", "rank", "label", *[F.round(n, 5).alias(n) for n in _EXTRA])


@query(f"WITH {_LIST} SELECT row_id, sid, rank, round({linear_sql(LIST_MODEL)}, 6) AS score FROM lf")
def listwise_score(fx: Fixtures) -> DataFrame:
    return learn.scored(_listwise(fx), LIST_MODEL).select("row_id", "sid", "rank", "score")


@query(f"""WITH {_LIST}, s AS (SELECT row_id, label, {linear_sql(LIST_MODEL)} AS score, {', '.join(f'(({n} - {m}) / {s}) AS z{i}' for i, (n, m, s) in enumerate(zip(LIST_MODEL['features'], LIST_MODEL['mean'], LIST_MODEL['scale'], strict=True)))} FROM lf), g AS (SELECT row_id, max(score) AS top FROM s GROUP BY 1 HAVING max(label) = 1),
    e AS (SELECT s.*, exp(score - top) AS e FROM s JOIN g USING (row_id)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e)
    SELECT sum(label) AS n_rows, round(sum(CASE WHEN label = 1 THEN -ln(p) ELSE 0 END) / sum(label), 5) AS loss, round(sum((p - label) * z0) / sum(label), 5) AS g_first, round(sum((p - label) * z20) / sum(label), 5) AS g_last FROM p""")
def listwise_gradient(fx: Fixtures) -> DataFrame:
    m = LIST_MODEL
    g = learn.listwise_gradient(_listwise(fx), m["features"], m["weights"], m["mean"], m["scale"])
    return g.select("n_rows", F.round("loss", 5).alias("loss"), F.round(F.col("gradient")[0], 5).alias("g_first"), F.round(F.col("gradient")[20], 5).alias("g_last"))


_GRID = f"""WITH sc AS (SELECT row_id, sid, rank, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, rank) - 1 AS new_rank FROM (SELECT *, round({linear_sql(MODEL)}, 6) AS score FROM vfeat)),
    x AS (SELECT s.row_id, rank, new_rank, s.sid = t.sid AND g.n_items = 1 AS strict, k.n_keys FROM sc s JOIN valid v ON v.row_id = s.row_id JOIN enr_a t ON t.item = v.target JOIN grp_a g ON g.sid = s.sid LEFT JOIN key_a k ON k.sid = s.sid AND k.key = t.key),
    o AS (SELECT *, row_number() OVER (PARTITION BY lam, rrf_k, row_id ORDER BY round(1 / (rrf_k + 1 + rank) + lam / (rrf_k + 1 + new_rank), 9) DESC, rank) AS r FROM x, (VALUES {', '.join(f'(CAST({v} AS DOUBLE))' for v in learn.LAMBDAS)}) a(lam), (VALUES (10), (60)) b(rrf_k)),
    h AS (SELECT lam, rrf_k, row_id, max(CAST(strict AS INT)) AS s, coalesce(arg_min(CAST(n_keys = 1 AS INT), r) FILTER (n_keys IS NOT NULL), 0) AS p FROM o WHERE r <= 10 GROUP BY 1, 2, 3), c AS (SELECT lam, rrf_k, sum(s) AS strict_hits, sum(p) AS product_hits FROM h GROUP BY 1, 2)"""


def _grid(fx: Fixtures) -> DataFrame:
    return learn.grid(fx.beam(split="valid"), learn.scored(_by_sid(fx, "valid"), MODEL), fx.catalog())


@query(f"{_GRID} SELECT * FROM c")
def grid_cells(fx: Fixtures) -> DataFrame:
    return _grid(fx)


@query(f"{_GRID} SELECT * FROM c ORDER BY strict_hits DESC, product_hits DESC, lam, rrf_k LIMIT 1")
def grid_select(fx: Fixtures) -> DataFrame:
    return learn.selected(_grid(fx))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(1 / (11 + rank) + 1.0 / (11 + new_rank), 9) DESC, rank) - 1 AS fused_rank FROM {_SCORED}),
    o AS (SELECT 'base' AS variant, row_id, sid, rank AS pos FROM s UNION ALL SELECT 'learned', row_id, sid, new_rank FROM s UNION ALL SELECT 'fused', row_id, sid, fused_rank FROM s), q AS (SELECT variant, row_id, sid, row_number() OVER (PARTITION BY variant, row_id ORDER BY pos) - 1 AS place FROM o),
    h AS (SELECT variant, q.row_id, min(place) FILTER (q.sid = t.sid) AS code_pos, any_value(t.n_items) AS ti, arg_min(k.n_keys, place) FILTER (k.key IS NOT NULL AND t.n_keys = 1) AS ak FROM q JOIN test USING (row_id) JOIN enr_a t ON t.item = target LEFT JOIN key_a k ON k.sid = q.sid AND k.key = t.key WHERE place < 10 GROUP BY 1, 2)
    SELECT variant, count(*) AS n_rows, count(code_pos) AS code_hits, count(code_pos) FILTER (ti = 1) AS strict_hits, count(*) FILTER (ak = 1) AS product_hits FROM h GROUP BY 1""")
def apply_compare(fx: Fixtures) -> DataFrame:
    return learn.compare(fx.beam(), learn.scored(_by_sid(fx), MODEL), fx.catalog())


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(1 / (11 + rank) + 1.0 / (11 + new_rank), 9) DESC, rank) - 1 AS fused_rank FROM {_SCORED}),
    q AS (SELECT variant, row_id, sid, row_number() OVER (PARTITION BY variant, row_id ORDER BY pos) - 1 AS place FROM (SELECT 'base' AS variant, row_id, sid, rank AS pos FROM s UNION ALL SELECT 'learned', row_id, sid, new_rank FROM s UNION ALL SELECT 'fused', row_id, sid, fused_rank FROM s)),
    h AS (SELECT variant, q.row_id, min(place) FILTER (q.sid = t.sid) AS code_pos, any_value(t.n_items) AS ti, arg_min(k.n_keys, place) FILTER (k.key IS NOT NULL AND t.n_keys = 1 AND place < 10) AS ak FROM q JOIN test USING (row_id) JOIN enr_a t ON t.item = target LEFT JOIN key_a k ON k.sid = q.sid AND k.key = t.key GROUP BY 1, 2)
    SELECT variant, count(*) AS n_rows, round(avg(CAST(coalesce(code_pos < 10, false) AS INT)), 6) AS code_hr, round(avg(CAST(coalesce(code_pos < 10 AND ti = 1, false) AS INT)), 6) AS strict_hr, round(avg(CAST(coalesce(ak = 1, false) AS INT)), 6) AS product_hr,
    round(avg(coalesce(1 / ak, 0.0)), 6) AS product_fraction, round(avg(CAST(code_pos IS NOT NULL AS INT)), 6) AS code_ceiling, round(avg(CAST(code_pos IS NOT NULL AND ti = 1 AS INT)), 6) AS strict_ceiling FROM h GROUP BY 1""")
def protocol_scores(fx: Fixtures) -> DataFrame:
    return learn.protocol_scores(fx.beam(), learn.scored(_by_sid(fx), MODEL), fx.catalog())


_SUBSET_SCORES = " UNION ALL ".join(f"SELECT '{name}' AS subset, row_id, sid, rank, round({linear_sql(learn.subset_model(LIST_MODEL, names))}, 6) AS score FROM lf" for name, names in features.SUBSETS.items())
_SUBSET_GRID = f"""WITH {_LIST}, ss AS ({_SUBSET_SCORES}), sp AS (SELECT *, row_number() OVER (PARTITION BY subset, row_id ORDER BY score DESC, rank) - 1 AS place FROM ss),
    sh AS (SELECT subset, p.row_id, min(place) FILTER (p.sid = t.sid) AS code_pos, any_value(t.n_items) AS ti, arg_min(k.n_keys, place) FILTER (k.key IS NOT NULL AND t.n_keys = 1) AS ak FROM sp p JOIN test USING (row_id) JOIN enr_a t ON t.item = target LEFT JOIN key_a k ON k.sid = p.sid AND k.key = t.key WHERE place < 10 GROUP BY 1, 2),
    sg AS (SELECT subset, count(*) AS n_rows, count(code_pos) AS code_hits, count(code_pos) FILTER (ti = 1) AS strict_hits, count(*) FILTER (ak = 1) AS product_hits FROM sh GROUP BY 1)"""


def _subsets(fx: Fixtures) -> DataFrame:
    return learn.subset_grid(fx.beam(), _listwise(fx), LIST_MODEL, fx.catalog())


@query(f"{_SUBSET_GRID} SELECT * FROM sg")
def subset_cells(fx: Fixtures) -> DataFrame:
    return _subsets(fx)


@query(f"{_SUBSET_GRID} SELECT * FROM sg ORDER BY strict_hits DESC, product_hits DESC, list_position([{', '.join(f'{chr(39)}{n}{chr(39)}' for n in features.SUBSETS)}], subset) LIMIT 1")
def subset_select(fx: Fixtures) -> DataFrame:
    return learn.selected_subset(_subsets(fx), list(features.SUBSETS))


_BOTH = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(1 / (11 + rank) + 1.0 / (11 + new_rank), 9) DESC, rank) - 1 AS place FROM {_SCORED}),
    h AS (SELECT s.row_id, min(place) FILTER (s.sid = t.sid) AS code_pos, any_value(t.n_items) AS ti, arg_min(k.n_keys, place) FILTER (k.key IS NOT NULL AND t.n_keys = 1) AS ak FROM s JOIN test USING (row_id) JOIN enr_a t ON t.item = target LEFT JOIN key_a k ON k.sid = s.sid AND k.key = t.key WHERE place < 10 GROUP BY 1),
    w AS (SELECT c_nationkey AS cluster, [CAST(x.code_pos IS NOT NULL AS INT), CAST(x.strict_pos IS NOT NULL AS INT), CAST(x.product_pos IS NOT NULL AND NOT x.ambiguous_target AS INT)] AS a,
      [CAST(h.code_pos IS NOT NULL AS INT), CAST(coalesce(h.code_pos IS NOT NULL AND ti = 1, false) AS INT), CAST(coalesce(ak = 1, false) AS INT)] AS b FROM hits10_test42a x LEFT JOIN h USING (row_id) JOIN customer ON c_custkey = x.row_id // 100000),
    d AS (SELECT cluster, a, b, [b[1] - a[1], b[2] - a[2], b[3] - a[3]] AS d FROM w),
    rg AS (SELECT 0 AS s, row_number() OVER (ORDER BY d) - 1 AS idx, d, 1 AS size, count(*) AS n FROM d GROUP BY d),
    ug AS (SELECT 0 AS s, row_number() OVER (ORDER BY d, size) - 1 AS idx, d, size, count(*) AS n FROM (SELECT [sum(d[1]), sum(d[2]), sum(d[3])] AS d, count(*) AS size FROM d GROUP BY cluster) GROUP BY d, size),
    rp AS (SELECT g AS round, 0 AS stream, 0 AS s, n AS draws FROM (SELECT count(*) AS n FROM d), range({ROUNDS}) r(g)),
    up AS (SELECT g AS round, 0 AS stream, 0 AS s, n AS draws FROM (SELECT count(DISTINCT cluster) AS n FROM d), range({ROUNDS}) r(g)),
    {oracles.splitting_tree("rt", 13, "rg", "rp")}, {oracles.splitting_tree("ut", 17, "ug", "up")},
    rs AS (SELECT p, round, sum(rt.n * d[p]) / sum(rt.n * size) AS v FROM rt JOIN rg USING (s, idx), range(1, 4) q(p) GROUP BY p, round),
    us AS (SELECT p, round, sum(ut.n * d[p]) / sum(ut.n * size) AS v FROM ut JOIN ug USING (s, idx), range(1, 4) q(p) GROUP BY p, round),
    ri AS (SELECT p, {_INTERVAL} FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY v) - 1 AS r FROM rs) GROUP BY 1),
    ui AS (SELECT p, {_INTERVAL} FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY v) - 1 AS r FROM us) GROUP BY 1)
    SELECT ['code', 'strict', 'product'][p] AS protocol, count(*) AS n_rows, sum(a[p]) AS base_hits, sum(b[p]) AS new_hits, round(avg(d[p]), 6) AS diff, round(any_value(ri.lo), 6) AS ci_lo, round(any_value(ri.hi), 6) AS ci_hi, round(any_value(ui.lo), 6) AS user_lo, round(any_value(ui.hi), 6) AS user_hi FROM d, range(1, 4) r(p) JOIN ri USING (p) JOIN ui USING (p) GROUP BY p"""


@query(_BOTH)
def compare_ci(fx: Fixtures) -> DataFrame:
    users = fx.table("customer").select(F.col("c_custkey").alias("u"), F.col("c_nationkey").alias("cluster"))
    beam = fx.beam()
    clusters = beam.select("row_id", F.floor(F.col("row_id") / 100000).alias("u")).join(users, "u")
    return learn.comparison(beam, rank.fused(learn.scored(_by_sid(fx), MODEL)), fx.catalog(), clusters, rounds=ROUNDS)


# ---------------------------------------------------------------- learning


def _draw(kind: str) -> str:
    return oracles.u32("17", "row_id", "slot", f"'{kind}'")


@query(f"""WITH spots AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, target AS item FROM train), total AS (SELECT count(*) AS total FROM train),
    cum AS (SELECT item AS near, other AS item, hi, coalesce(lag(hi) OVER (PARTITION BY item ORDER BY rnk), 0.0) AS lo FROM (SELECT item, other, rnk, round(sum(ppmi) OVER (PARTITION BY item ORDER BY rnk), 9) AS hi FROM adj WHERE rnk <= 200)), top AS (SELECT near, max(hi) AS s FROM cum GROUP BY 1),
    lk AS (SELECT row_id, list(near ORDER BY near) AS linked FROM (SELECT row_id, unnest(list_distinct(hist)) AS near FROM train) JOIN top USING (near) GROUP BY 1),
    d AS (SELECT row_id, target, {_draw('k')} % 1000 AS kind, {_draw('p')} % total AS idx, hist[{_draw('h')} % len(hist) + 1] AS own, linked[{_draw('i')} % len(linked) + 1] AS near, {_draw('n')} AS un, slot FROM train LEFT JOIN lk USING (row_id), range(12) r(slot), total),
    e AS (SELECT d.*, s FROM d LEFT JOIN top USING (near))
    SELECT row_id, item, CAST(min(slot) AS INT) AS slot FROM (SELECT row_id, target, slot, p.item FROM e JOIN spots p USING (idx) WHERE kind < 400 OR (kind < 700 AND s IS NULL)
    UNION ALL SELECT e.row_id, e.target, slot, c.item FROM e JOIN cum c ON c.near = e.near AND un / 4294967296.0 * s >= lo AND un / 4294967296.0 * s < hi WHERE kind BETWEEN 400 AND 699 UNION ALL SELECT row_id, target, slot, own FROM e WHERE kind >= 700) WHERE item <> target GROUP BY row_id, item""")
def negative_sample(fx: Fixtures) -> DataFrame:
    train = fx.rows("train")
    return sampling.negatives(train, train, cooc.History(train))


@query(f"""WITH near AS (SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, item) AS place FROM (SELECT row_id, other AS item, max(ppmi) AS v FROM (SELECT row_id, unnest(list_distinct(hist)) AS item FROM test) JOIN adj USING (item) WHERE rnk <= 200 GROUP BY 1, 2)), top AS (SELECT * FROM near WHERE place <= 60),
    pool AS (SELECT row_id, item, place FROM top UNION ALL SELECT t.row_id, p.item, 60 + p.rnk FROM test t, popular p WHERE p.rnk <= 40 AND NOT EXISTS (SELECT 1 FROM top WHERE top.row_id = t.row_id AND top.item = p.item)),
    pools AS (SELECT row_id, list(item ORDER BY place) AS items FROM pool JOIN test USING (row_id) WHERE item <> target AND len(hist) > 0 GROUP BY 1)
    SELECT row_id, item, CAST(min(slot) AS INT) AS slot FROM (SELECT row_id, slot, items[{_draw('b')} % len(items) + 1] AS item FROM pools, range(12) r(slot)) GROUP BY row_id, item""")
def beamlike_negatives(fx: Fixtures) -> DataFrame:
    train = fx.rows("train")
    return sampling.beamlike_negatives(fx.rows(), train, cooc.History(train))


def _model_rows(fx: Fixtures, m: dict) -> DataFrame:
    rows = [(n, float(mu), float(s), float(w)) for n, mu, s, w in zip(m["features"], m["mean"], m["scale"], m["weights"], strict=True)]
    return fx.spark.createDataFrame(rows + ([("bias", 0.0, 1.0, float(m["bias"]))] if "bias" in m else []), "feature string, mean double, scale double, weight double")


@query()
def fit_pointwise(fx: Fixtures) -> DataFrame:
    train = fx.rows("train")
    st = features.Stats(train, fx.catalog())
    samples = written(sampling.fresh_examples(train, train, cooc.History(train), draws=5), "samples")
    return _model_rows(fx, learn.fit_pointwise(written(learn.pointwise_examples(samples, train, st), "examples")))


@query()
def fit_listwise(fx: Fixtures) -> DataFrame:
    return _model_rows(fx, learn.fit_listwise(_listwise(fx), features.LISTWISE))


_LOGIT = oracles.u32("5", "row_id", "level", "code")


def _argmax_sql(k: int) -> str:
    return f"""WITH lg AS (SELECT row_id, level, code, {_LOGIT} % 1000 AS v FROM test, (SELECT DISTINCT level, code FROM ({_CODES})))
    SELECT row_id, sid, CAST(score AS DOUBLE) AS score{", r AS place" * (k > 1)} FROM (SELECT t.row_id, e.sid, x.v + y.v + z.v AS score, CAST(row_number() OVER (PARTITION BY t.row_id ORDER BY x.v + y.v + z.v DESC, e.sid) AS INT) AS r FROM test t, (SELECT DISTINCT sid, CAST(regexp_extract(sid, '<a_([0-9]+)>', 1) AS INT) AS a, CAST(regexp_extract(sid, '<b_([0-9]+)>', 1) AS INT) AS b, CAST(regexp_extract(sid, '<c_([0-9]+)>', 1) AS INT) AS c FROM cat_a) e
    JOIN lg x ON x.row_id = t.row_id AND x.level = 'a' AND x.code = e.a JOIN lg y ON y.row_id = t.row_id AND y.level = 'b' AND y.code = e.b JOIN lg z ON z.row_id = t.row_id AND z.level = 'c' AND z.code = e.c) WHERE r <= {k}"""


def _logits(fx: Fixtures) -> DataFrame:
    codes = fx.catalog().select(F.explode(F.array(*[F.struct(F.lit(v).alias("level"), S.code(F.col("sid"), v).alias("code")) for v in "abc"])).alias("x")).select("x.*").distinct()
    return fx.rows().select("row_id").crossJoin(F.broadcast(codes)).withColumn("v", u32(5, F.col("row_id"), F.col("level"), F.col("code")) % 1000)  # codebooks are of fixed size


@query(_argmax_sql(1))
def catalog_argmax(fx: Fixtures) -> DataFrame:
    return trie.best_sids(_logits(fx), fx.catalog())


@query(_argmax_sql(10))
def catalog_top_k(fx: Fixtures) -> DataFrame:
    return trie.best_sids(_logits(fx), fx.catalog(), k=10)


@query()
def train_predictor(fx: Fixtures) -> DataFrame:
    train = _sid_examples(fx, "train")
    net, report = predictor.train(train, predictor.vocabulary(train))
    return fx.spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(report["losses"])], "epoch int, loss double")
