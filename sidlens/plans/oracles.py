"""DuckDB text for the derived inputs, put before a query as far as it names them."""

from __future__ import annotations

import re


def u32(*xs: str) -> str:
    """SQL of the hash draw; arguments are SQL texts."""
    return f"CAST('0x' || substr(md5({' || chr(124) || '.join(f'CAST({x} AS VARCHAR)' for x in xs)}), 1, 8) AS BIGINT)"


_PKEY = "trim(regexp_replace(lower(title), '[\\s\\x00-\\x1f]+', ' ', 'g'))"

TABLES: dict[str, str] = {
    "inter": """SELECT o_custkey AS u, l_partkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "cat_a": """SELECT p_partkey AS item, '<a_' || regexp_extract(p_brand, '[0-9]+') || '><b_' || (dense_rank() OVER (ORDER BY p_type) - 1) || '><c_' || p_size || '>' AS sid, p_name AS title FROM part""",
    "cat_b": """SELECT p_partkey AS item, '<a_' || (p_partkey % 16) || '><b_' || ((p_partkey // 16) % 16) || '><c_' || (p_partkey // 256) || '>' AS sid, p_name AS title FROM part""",
    "ex": """SELECT u * 100000 + pos AS row_id, * FROM (SELECT u, pos, n, item AS target, list(item) OVER (PARTITION BY u ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hist FROM inter) WHERE pos > 1""",
    "test": "SELECT row_id, u, pos, target, hist FROM ex WHERE pos = n",
    "valid": "SELECT row_id, u, pos, target, hist FROM ex WHERE pos = n - 1",
    "train": "SELECT row_id, u, pos, target, hist FROM ex WHERE pos < n - 1",
    "tr_items": "SELECT row_id, unnest(list_distinct(hist)) AS item FROM train",
    "pairs": "SELECT a.item AS a, b.item AS b, count(*) AS c FROM tr_items a JOIN tr_items b ON a.row_id = b.row_id AND a.item < b.item GROUP BY 1, 2",
    "hist_n": "SELECT item, count(*) AS n FROM tr_items GROUP BY 1",
    "target_n": "SELECT target AS item, count(*) AS n FROM train GROUP BY 1",
    "pmi": """SELECT * FROM (SELECT a, b, c, round(ln(c * CAST((SELECT sum(c) FROM pairs) AS DOUBLE) / (x.n * CAST(y.n AS DOUBLE))), 9) AS ppmi FROM pairs JOIN hist_n x ON x.item = a JOIN hist_n y ON y.item = b) WHERE ppmi > 0""",
    "sym": "SELECT a AS item, b AS other, c, ppmi FROM pmi UNION ALL SELECT b, a, c, ppmi FROM pmi",
    "adj": "SELECT item, other, ppmi, row_number() OVER (PARTITION BY item ORDER BY ppmi DESC, other) AS rnk FROM sym",
    "popular": "SELECT item, n, row_number() OVER (ORDER BY n DESC, f) AS rnk FROM (SELECT target AS item, count(*) AS n, min(row_id) AS f FROM train GROUP BY 1)",
    "lev": """SELECT level, code, sum(n) AS n FROM (SELECT n, 1 AS level, l1 AS code FROM target_n JOIN enr_a USING (item) UNION ALL SELECT n, 2, l2 FROM target_n JOIN enr_a USING (item)) GROUP BY 1, 2""",
    "prior": """SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item) AS rnk FROM (
        SELECT row_id, other AS item, round(sum(ppmi), 9) AS score FROM (SELECT row_id, unnest(list_distinct(hist)) AS item FROM test) JOIN sym USING (item) GROUP BY 1, 2)""",
    "vecs": "SELECT p_partkey AS item, embedding AS vec FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)",
    "mlog": f"SELECT event_type AS log, event_id % 500 AS step, min({u32(chr(39) + 'm' + chr(39), 'event_id')}) % 1000 / 1000 AS hr10 FROM events GROUP BY 1, 2",
}
for _arm in "ab":
    TABLES[f"grp_{_arm}"] = f"SELECT sid, count(*) AS n_items, count(DISTINCT {_PKEY}) AS n_keys FROM cat_{_arm} GROUP BY 1"
    TABLES[f"enr_{_arm}"] = f"SELECT item, sid, {_PKEY} AS key, regexp_extract(sid, '<a_([0-9]+)>', 1) AS l1, regexp_extract(sid, '<a_([0-9]+)>', 1) || '_' || regexp_extract(sid, '<b_([0-9]+)>', 1) AS l2, n_items, n_keys FROM cat_{_arm} JOIN grp_{_arm} USING (sid)"
    TABLES[f"key_{_arm}"] = f"SELECT sid, key, any_value(n_keys) AS n_keys FROM enr_{_arm} GROUP BY 1, 2"
    for _split in ("test", "valid"):
        for _seed in (42, 43, 44):
            _b = f"{_split}{_seed}"
            TABLES[f"bi_{_b}"] = f"""SELECT row_id, u, target, slot, CASE WHEN {u32(str(_seed), 'u', "'hit'")} % 100 < 30 AND slot = {u32(str(_seed), 'u', "'rank'")} % 50 THEN target
                WHEN slot = 0 AND {u32(str(_seed), 'u', "'copy'")} % 100 < 45 THEN hist[-1] ELSE {u32(str(_seed), 'u', 'slot')} % (SELECT count(*) FROM part) END AS item FROM {_split}, range(50) AS r(slot)"""
            _n = f"{_b}{_arm}"
            TABLES[f"slots_{_n}"] = f"SELECT row_id, u, target, slot AS pos, sid, item FROM bi_{_b} JOIN cat_{_arm} USING (item)"
            TABLES[f"beam_{_n}"] = f"SELECT row_id, u, target, t.sid AS output, predict FROM (SELECT row_id, u, target, list(sid ORDER BY pos) AS predict FROM slots_{_n} GROUP BY 1, 2, 3) JOIN cat_{_arm} t ON t.item = target"
            for _k in (10, 50):
                TABLES[f"hits{_k}_{_n}"] = f"""SELECT row_id, target, code_pos, CASE WHEN t_items = 1 THEN code_pos END AS strict_pos, CASE WHEN code_pos IS NULL THEN 0.0 ELSE 1 / t_items END AS fraction,
                    CASE WHEN any_keys = 1 THEN any_pos END AS product_pos, CASE WHEN any_pos IS NULL THEN 0.0 ELSE 1 / any_keys END AS product_fraction, t_items = 1 AS unique_target, t_keys > 1 AS ambiguous_target
                    FROM (SELECT s.row_id, s.target, any_value(t.n_items) AS t_items, any_value(t.n_keys) AS t_keys, min(s.pos) FILTER (s.sid = t.sid) AS code_pos, min(s.pos) FILTER (k.key IS NOT NULL) AS any_pos, arg_min(k.n_keys, s.pos) FILTER (k.key IS NOT NULL) AS any_keys
                    FROM slots_{_n} s JOIN enr_{_arm} t ON t.item = s.target LEFT JOIN key_{_arm} k ON k.sid = s.sid AND k.key = t.key WHERE s.pos < {_k} GROUP BY 1, 2)"""
_bad = f"{u32('42', 'u', chr(39) + 'bad' + chr(39))} % 100"
TABLES["faulty"] = f"SELECT row_id, u, target, output, [CASE WHEN {_bad} < 5 AND i = 50 THEN '<a_99><b_0><c_0>' WHEN {_bad} BETWEEN 5 AND 9 AND i = 49 THEN predict[1] ELSE predict[i] END FOR i IN range(1, 51)] AS predict FROM beam_test42a"
TABLES["cand"] = "SELECT row_id, sid, min(pos) AS rank FROM slots_test42a GROUP BY 1, 2"
# Ranks are places among distinct candidates.
TABLES["dist"] = "SELECT row_id, sid, row_number() OVER (PARTITION BY row_id ORDER BY rank) - 1 AS rank FROM cand"
TABLES["vdist"] = "SELECT row_id, sid, row_number() OVER (PARTITION BY row_id ORDER BY rank) - 1 AS rank FROM (SELECT row_id, sid, min(pos) AS rank FROM slots_valid42a GROUP BY 1, 2)"


def features(cand: str, rows: str) -> str:
    """SQL of the 14 features of candidates (row_id, item) of `cand`."""
    return f"""SELECT k.row_id, k.item, e.sid,
        coalesce(s.ps / sqrt(greatest(len(h.hist), 1)), 0) AS ppmi_sum, coalesce(s.pm, 0) AS ppmi_max, coalesce(s.cn / sqrt(greatest(len(h.hist), 1)), 0) AS cooc_norm,
        ln(1 + coalesce(t.n, 0)) AS pop_log, CAST(list_contains(h.hist, k.item) AS INT) AS in_history, CAST(h.hist[-1] = k.item AS INT) AS last_same,
        coalesce(g.f1, 0) / greatest(len(list_distinct(h.hist)), 1) AS l1_frac, coalesce(g.f2, 0) / greatest(len(list_distinct(h.hist)), 1) AS l2_frac,
        CAST(coalesce(p.l1 = e.l1, false) AS INT) AS prev_l1, CAST(coalesce(p.l2 = e.l2, false) AS INT) AS prev_l2, ln(1 + len(h.hist)) AS hist_len_log, CAST(e.n_items > 1 AS INT) AS sid_shared,
        ln(1 + coalesce(v1.n, 0)) - ln(1 + (SELECT count(*) FROM train)) AS pop_l1_rate, ln(1 + coalesce(v2.n, 0)) - ln(1 + (SELECT count(*) FROM train)) AS pop_l2_rate
        FROM (SELECT DISTINCT row_id, item FROM {cand}) k JOIN enr_a e USING (item) JOIN {rows} h ON h.row_id = k.row_id LEFT JOIN enr_a p ON p.item = h.hist[-1]
        LEFT JOIN (SELECT c.row_id, c.item, sum(ppmi) AS ps, max(ppmi) AS pm, sum(y.c / greatest(n, 1)) AS cn FROM (SELECT DISTINCT row_id, item FROM {cand}) c JOIN (SELECT row_id, unnest(list_distinct(hist)) AS other FROM {rows}) o ON o.row_id = c.row_id JOIN sym y ON y.item = c.item AND y.other = o.other JOIN hist_n m ON m.item = y.other GROUP BY 1, 2) s ON s.row_id = k.row_id AND s.item = k.item
        LEFT JOIN target_n t ON t.item = k.item
        LEFT JOIN (SELECT c.row_id, c.item, count(*) FILTER (z.l1 = w.l1) AS f1, count(*) FILTER (z.l2 = w.l2) AS f2 FROM (SELECT DISTINCT row_id, item FROM {cand}) c JOIN enr_a w ON w.item = c.item JOIN (SELECT row_id, unnest(list_distinct(hist)) AS other FROM {rows}) o ON o.row_id = c.row_id JOIN enr_a z ON z.item = o.other GROUP BY 1, 2) g ON g.row_id = k.row_id AND g.item = k.item
        LEFT JOIN lev v1 ON v1.level = 1 AND v1.code = e.l1 LEFT JOIN lev v2 ON v2.level = 2 AND v2.code = e.l2"""


_NAMES = ("ppmi_sum", "ppmi_max", "cooc_norm", "pop_log", "in_history", "last_same", "l1_frac", "l2_frac", "prev_l1", "prev_l2", "hist_len_log", "sid_shared", "pop_l1_rate", "pop_l2_rate")
TABLES["test_items"] = "SELECT DISTINCT row_id, c.item FROM dist JOIN cat_a c USING (sid)"
TABLES["valid_items"] = "SELECT DISTINCT row_id, c.item FROM vdist JOIN cat_a c USING (sid)"
TABLES["feat_items"] = features("test_items", "test")
TABLES["vfeat_items"] = features("valid_items", "valid")
_avg = ", ".join(f"avg({n}) AS {n}" for n in _NAMES)
TABLES["feat"] = f"SELECT d.row_id, d.sid, d.rank, {', '.join('f.' + n for n in _NAMES)} FROM dist d JOIN (SELECT row_id, sid, {_avg} FROM feat_items GROUP BY 1, 2) f USING (row_id, sid)"
TABLES["vfeat"] = f"SELECT d.row_id, d.sid, d.rank, {', '.join('f.' + n for n in _NAMES)} FROM vdist d JOIN (SELECT row_id, sid, {_avg} FROM vfeat_items GROUP BY 1, 2) f USING (row_id, sid)"


def splitting_tree(name: str, seed: int, groups: str, plan: str) -> str:
    """CTEs of which `name` has (round, stream, s, idx, n): how many draws fall on each group. groups: (s, idx, n, ...), idx from 0 in each set s; plan: (round, stream, s, draws). A row of the recursion is a node and what its split has decided so far."""
    word = f"CAST('0x' || substr(md5('{seed}|' || round || '|' || stream || '|' || s || '|' || lo || '|' || hi || '|' || j || '|' || i), 1, 15) AS BIGINT)"
    ones = f"CASE WHEN u > 0 AND r > 0 AND r < m THEN list_sum(list_transform(range(CAST(ceil(u / 60.0) AS BIGINT)), lambda i: bit_count(CASE WHEN u - 60 * i < 60 THEN {word} & ((CAST(1 AS BIGINT) << CAST(u - 60 * i AS INTEGER)) - 1) ELSE {word} END))) ELSE 0 END"
    half = lambda w: f"list_max(list_filter([CAST(1 AS BIGINT) << CAST(x AS INTEGER) FOR x IN range(40)], lambda p: p < {w}))"
    node = lambda lo, hi, n: f"{{'lo': {lo}, 'hi': {hi}, 'n': {n}, 'u': {n}, 'k': 0, 'r': cum[{lo} + coalesce({half(f'({hi}) - ({lo})')}, 0) + 1] - cum[{lo} + 1], 'm': cum[{hi} + 1] - cum[{lo} + 1], 'j': 0}}"
    kinds = "STRUCT(lo BIGINT, hi BIGINT, n BIGINT, u BIGINT, k BIGINT, r BIGINT, m BIGINT, j BIGINT)"
    return f"""{name}_c AS (SELECT s, list_prepend(CAST(0 AS BIGINT), list(c ORDER BY idx)) AS cum, count(*) AS g FROM (SELECT s, idx, CAST(sum(n) OVER (PARTITION BY s ORDER BY idx) AS BIGINT) AS c FROM {groups}) GROUP BY s),
    {name}_t AS (
        SELECT round, stream, s, x.lo, x.hi, x.n, x.u, x.k, x.r, x.m, x.j FROM (SELECT round, stream, s, CAST({node('0', 'g', 'draws')} AS {kinds}) AS x FROM {plan} JOIN {name}_c USING (s))
        UNION ALL
        SELECT round, stream, s, x.lo, x.hi, x.n, x.u, x.k, x.r, x.m, x.j FROM (
            SELECT round, stream, s, unnest(CASE WHEN u > 0 AND r >= m THEN [CAST({{'lo': lo, 'hi': hi, 'n': n, 'u': 0, 'k': k + u, 'r': r, 'm': m, 'j': j}} AS {kinds})]
                WHEN u > 0 AND r > 0 THEN [CAST({{'lo': lo, 'hi': hi, 'n': n, 'u': CASE WHEN 2 * r >= m THEN u - z ELSE z END, 'k': CASE WHEN 2 * r >= m THEN k + z ELSE k END, 'r': CASE WHEN 2 * r >= m THEN 2 * r - m ELSE 2 * r END, 'm': m, 'j': j + 1}} AS {kinds})]
                ELSE [CAST({node('lo', '(lo + half)', 'k')} AS {kinds}), CAST({node('(lo + half)', 'hi', '(n - k)')} AS {kinds})] END) AS x
            FROM (SELECT *, {ones} AS z, {half('hi - lo')} AS half FROM {name}_t JOIN {name}_c USING (s) WHERE hi - lo > 1 AND n > 0))),
    {name} AS (SELECT round, stream, s, lo AS idx, n FROM {name}_t WHERE hi - lo = 1 AND n > 0)"""


def with_tables(sql: str) -> str:
    """The query after the definitions of what it names."""
    needed: dict[str, str] = {}

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in TABLES and name not in needed:
                needed[name] = ""  # for cycles, of which there are none
                add(TABLES[name])
                needed[name] = needed.pop(name) or TABLES[name]

    add(sql)
    own = sql.strip()
    head = ",\n".join(f"{n} AS ({t})" for n, t in needed.items())
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(start):
            return f"{start}{head},\n{own[len(start) :]}" if head else own
    return f"WITH {head}\n{own}" if head else own
