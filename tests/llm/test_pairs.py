import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from sidlens.llm import jaccard_join, suffix_dedup, topk, warc
from sidlens.llm.common import components
from sidlens.llm.queries import QUERIES, SQL
from test_text import EDGES, exact, table


def linked(rows, n, num, den=100):
    """Brute force: the least id of each row's component."""
    sets = [exact(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def documents(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w += rng.choices(words, k=3)
        else:
            w = rng.choices(words, k=rng.choice([1, 2, 3, 8, 30, 80, 200]))
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("words", "num", "cell"), [(3, 90, 2048), (5, 80, 2048), (2, 60, 5)])
def test_components(spark, monkeypatch, words, num, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = documents(160, words) + [(1000, None), (1001, " "), (1002, "Word"), (1003, "wORD"), (7, "a b c d e f g")]
    got = jaccard_join.similar_components(table(spark, rows), words, num).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == linked(rows, words, num)


@pytest.mark.parametrize("cell", [256, 5])
def test_links(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "LINKED", cell)
    rows = documents(160, 2) + [(1000, None), (1001, " "), (1002, "Word"), (1003, "wORD"), (7, "a b c d e f g")]
    sets = [frozenset(exact(t, 2)) for _, t in rows]
    link = lambda x, y: bool(x and y) and 100 * len(x & y) >= 60 * len(x | y)
    got = jaccard_join.similar_components(table(spark, rows), 2, 60, count_links=True).collect()
    want = [(d, sum(link(s, t) for j, t in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted(want)
    classes = defaultdict(list)
    for (d, _), s in zip(rows, sets, strict=True):
        classes[s].append(d)
    of = {s: (min(d), len(d)) for s, d in classes.items()}
    pairs = {(*min(of[x], of[y]), *max(of[x], of[y])) for x in of for y in of if x != y and link(x, y)}
    assert len(pairs) > len(of) and sorted(tuple(r) for r in jaccard_join.similar_pairs(table(spark, rows), 2, 60).collect()) == sorted(pairs)
    assert "n_links" in QUERIES["op2_jaccard_components"](spark, "/root/testdata/sf0.001").columns


def test_allocation_with_deletions():
    bands = jaccard_join.Bands(80, 100, {4: 10**9, 5: 10**9})
    assert bands.loose.max() > 0
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randrange(10, 60)
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), n - rng.randrange(max(1, n // 10)))) | {10**7 + i for i in range(rng.randrange(max(1, n // 10)))}
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = (jaccard_join.mix(np.array(sorted(s), np.uint64)) for s in (a, b))
            ex, ey = jaccard_join.entries([np.sort(x), np.sort(y)], bands)
            assert set(ex.tolist()) & set(ey.tolist())


def test_join_edges(spark):
    assert len(jaccard_join.similar_components(table(spark, EDGES)).collect()) == len(EDGES)
    assert jaccard_join.similar_components(table(spark, [])).count() == 0
    kept = jaccard_join.one_of_each(table(spark, [(2, "a b c d e f g"), (1, "A b c d e f g"), (3, None), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_one_row_of_each_group(spark):
    x, y, z = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(1, x), (1, x), (2, x), (None, y), (None, y), (3, z), (2, z), (1, "v w x y z a b"), (4, None), (4, None), (None, "")]
    kept = jaccard_join.one_of_each(table(spark, rows)).collect()
    want = [(1, x), (None, y), (2, z), (1, "v w x y z a b"), (4, None), (4, None), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(want, key=repr)


def test_graph(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def removed(texts, length):
    count = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "most"), [(2048, 10**6), (3, 10**6), (3, 0)])
def test_repeats(spark, monkeypatch, group, most):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST", most)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    passages = [some(60) for _ in range(5)]
    rows = [(i, "".join(rng.choice([some(rng.randrange(30)), p := rng.choice(passages), p[:40], p[10:], "a" * rng.randrange(80)]) for _ in range(rng.randrange(6)))) for i in range(90)]
    rows += [(500, None), (None, passages[0]), (7, passages[1] + "x"), (7, passages[1] + "x"), (8, "")]
    got = sorted((tuple(r) for r in suffix_dedup.measure_repeats(table(spark, rows), 40).collect()), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(rows, removed([(t or "").encode() for _, t in rows], 40), strict=True)), key=repr)
    assert got == want


def test_repeats_leave_whole_characters(spark):
    t = "é" * 30
    df = table(spark, [(1, "a" + t), (2, t + "b"), (3, None)])
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df, 41).collect()} == {1: "a", 2: "b", 3: None}
    assert suffix_dedup.measure_repeats(table(spark, [])).count() == 0


def test_repeated_words(spark):
    rng = random.Random(5)
    some = lambda n: [rng.choice(["a", "bé", "C", "c", "d"]) for _ in range(n)]
    passages = [some(20) for _ in range(4)]
    part = lambda p: rng.choice([some(rng.randrange(20)), p, p[:13], p[6:]])
    rows = [(i, rng.choice([" ", "\n "]).join(w for _ in range(rng.randrange(5)) for w in part(rng.choice(passages)))) for i in range(80)]
    rows += [(500, None), (None, " ".join(passages[0])), (7, " ".join(passages[1])), (8, "")]
    split = [(t or "").split() for _, t in rows]
    count = defaultdict(int)
    for w in split:
        for i in range(len(w) - 11):
            count[tuple(w[i : i + 12])] += 1
    want = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - 11) if count[tuple(w[i : i + 12])] > 1 for j in range(i, i + 12)}
        want.append((d, [x for j, x in enumerate(w) if j not in gone]))
    left = suffix_dedup.without_repeats(table(spark, rows), 10_000, least_words=12).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").split()) for r in left), key=repr) == sorted(want, key=repr)


def test_stage_cuts_passages_of_51_words(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    shared, short, long = word("p", 51), word("q", 50), "x" * 400
    assert len(shared) < 400
    docs = table(spark, [(1, f"one {shared} two"), (2, f"three {shared} four"), (3, f"five {short} six"), (4, f"seven {short} eight"), (5, f"a {long} b"), (6, f"c {long} d")])
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert left == {1: "one  two", 2: "three  four", 3: f"five {short} six", 4: f"seven {short} eight", 5: "ab", 6: "cd"}


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(0, 0.2, (60, 6)), 2, 0).astype(np.float32).tolist()
    short = [[9.0], [-1.0], [3.0]]
    rows = [*enumerate(x), (500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (None, x[0]), (3, x[3]), *zip((600, 601, 602), short, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(df, df["vec_id"] % 10 == 0).collect()}
    ids, q = np.array([*range(120), 3]), np.floor(256 * np.array([*x, x[3]])).astype(int)
    want = {(600, 1, 602, 9 * 3 * 65536), (600, 2, 601, -9 * 65536)}
    for i in range(0, 120, 10):
        s = q @ q[i]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        want |= {(i, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), df["vec_id"] % 10 == 0).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    renamed = df.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), F.lit(1).alias("id"))
    assert {tuple(r)[:4] for r in topk.top_k(renamed, F.col("q") % 10 == 0, id_column="q", vector_column="v", count_evaluated=True).collect()} == want
    two = df.where("vec_id < 2")
    assert topk.top_k(two, two["vec_id"] % 10 == 0).count() == 1


def test_losers():
    rng = random.Random(0)
    for k in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert [x[0] for x in warc.LoserTree([iter([(v,) for v in r]) for r in runs])] == sorted(v for r in runs for v in r)


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 3)
    rows = [(1, "http://a.b/x\r\n%41", "x" * 200), (2, None, "x" * 200), (3, "http://[bad", "\r\n\r\nWARC/1.1" + "é" * 100), (None, "http://A.b:80/", None), (5, "", "y" * 99), (6, "u", "y" * 99), (7, "http://z.a.b/q?x=1#f", "x" * 200), (7, "http://z.a.b/q?x=1#f", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.capture_index(df.repartition(3), str(tmp_path / "archives")).collect()
    got.sort(key=lambda r: (r["range"], r["place"]))
    order = [(r["url_key"], r["captured"]) for r in got]
    assert len(got) == 8 and order == sorted(order)
    seen = defaultdict(int)
    for r in got:
        seen[r["url_key"]] += 1
        assert r["history"] == seen[r["url_key"]]
    by = {r["page_id"]: r for r in got}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in by.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), None: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 1)}
    assert all(by[i]["url"] == u for i, u, _ in rows)
    assert by[2]["payload_bytes"] == 200 and by[2]["payload_digest"] == hashlib.sha256(b"x" * 200).hexdigest()
    assert warc.capture_index(df.limit(0)).count() == 0


def test_history_goes_on_across_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 4)
    rows = [(i, "http://a.b/x" if i < 16 else f"http://a.b/y{i}", f"page {i}") for i in range(20)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:  # files of all ranges are read as one partition
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a")).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len({r["range"] for r in got}) > 2
    assert sorted((r["page_id"], r["history"]) for r in got) == [(i, i + 1 if i < 16 else 1) for i in range(20)]


def test_archives_of_large_pages_hold_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", {100: 4, 1 << 20: 2, 1 << 62: 1})
    rows = [(i, f"u{i}", "é" * n) for i, n in enumerate([0, 50, 51, 60, 10_000_000, 1 << 19, (1 << 19) + 1, 7, 3, 2])]
    df = spark.createDataFrame([*rows, (99, "u", None)], "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "a"
    got = {r["page_id"]: r for r in warc.capture_index(df, str(path)).collect()}
    assert {i: got[i]["payload_bytes"] for i, _, _ in rows} == {i: 2 * len(t) for i, _, t in rows} and got[99]["payload_bytes"] == 0
    assert {d.name: len(list(d.glob("*.gz"))) for d in path.iterdir() if d.is_dir()} == {"of-4": 2, "of-2": 2, "of-1": 2}


def test_pages_that_share_an_id(spark, tmp_path):
    rows = [(7, "u", "x" * 200), (7, "u", "z" * 300), (1, "u", "x" * 200), (8, "u", "q" * 300), (8, "u", "x" * 200), (9, "u", "q" * 300)]
    got = warc.capture_index(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int"), str(tmp_path / "a")).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(7, digest("x" * 200), 1), (7, digest("z" * 300), None), (1, digest("x" * 200), None), (8, digest("q" * 300), None), (8, digest("x" * 200), 1), (9, digest("q" * 300), 8)]
    assert sorted((r["page_id"], r["payload_digest"], r["refers_to"]) for r in got) == sorted(want)
    assert sorted(r["history"] for r in got) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    assert {tuple(r) for r in df.collect()} == set(c.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.saved(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    groups = jaccard_join.similar_components(docs).groupBy("component_id").count()
    assert sizes[4] >= groups.where("component_id IS NOT NULL").count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
