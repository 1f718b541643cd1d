import hashlib
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sidlens.llm import hard_negatives, merkle, simhash
from sidlens.llm.queries import QUERIES, SQL
from test_text import EDGES, table

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


# ---------------------------------------------------------------- Merkle manifest


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashed("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        lo = i // 16 * 16
        yield level[lo:i], level[i + 1 : lo + 16]
        i //= 16


def proven(rows):
    """Brute force over (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text, lang, source, n: hashed("".join(map(field, (d, source, lang, n, text))))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in names}
    trees = {s: levels([leaf(*r) for r in own[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            path = [*steps(trees[s], i), *steps(top, k)]
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf(r[0], lowered(r[1]), *r[2:]) if tampered else leaf(*r)
            for left, right in path:
                h = hashed("".join(left) + h + "".join(right))
            siblings = hashed("".join(x for left, right in path for x in left + right))
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], siblings, h, h == top[-1][0]))
    return sorted(map(str, out))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf int, TREE string"


def manifest_rows(n, sources):
    rng = random.Random(n)
    rows = [(i, f"Text {i} É", rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 7, -1])) for i in range(n)]
    return [*rows, *rows[:3]]


@pytest.mark.parametrize(("n", "sources"), [(600, ["a", "a", "a", None, "", "é", "\U0001f600", "＀"]), (40, [*map(str, range(18))]), (17, [None]), (1, ["x"]), (0, ["x"])])
def test_manifest(spark, n, sources):
    rows = manifest_rows(n, sources)
    rows += [(None, "no id", "en", sources[0], 1), (None, None, None, None, None), (3, "z" * 20_000, "en", sources[-1], 1)] if n > 20 else []
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], COLUMNS).repartition(5)
    got = merkle.verified(df, changes={"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}, when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == (proven(rows) if rows else [])


def test_one_row_has_an_empty_proof(spark):
    got = merkle.verified(spark.createDataFrame([(1, "t", "en", "s", 1, 5, "")], COLUMNS)).first()
    assert got["proof_sha256"] == hashed("") and got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["verified"]


def test_manifest_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(str(tuple(r)) for r in QUERIES["op11_merkle_manifest"](spark, SF).collect()) == proven([tuple(r) for r in docs.collect()])


# ---------------------------------------------------------------- SimHash


def printed(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    """A root for each fingerprint."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist():
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def near(rows):
    fps = [printed(t) for _, t in rows]
    roots, least = reach(fps), {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(str((d, f"{f:016x}", least.get(r))) for (d, _), f, r in zip(rows, fps, roots, strict=True))


def test_simhash_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op12_simhash_components"](spark, SF).collect()) == near(rows)


def test_simhash_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SOME", 7)
    rows = [*EDGES, (9, "Same SAME"), (10, "a b c\td \x0b e"), (11, "w " * 3000), (12, "É é x y"), (None, "alone and far away")]
    got = simhash.similar_components(table(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == near(rows)
    assert simhash.similar_components(table(spark, rows).limit(0)).count() == 0


def test_hash_is_sparks(spark):
    text = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == printed(text)


@pytest.mark.parametrize(("n_blocks", "bucket", "whole"), [(4, 1024, 1 << 16), (6, 1024, 1 << 16), (4, 8, 1 << 16), (4, 8, 40), (5, 4, 8)])
def test_links_connect_all_that_is_near(spark, monkeypatch, n_blocks, bucket, whole):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "WHOLE", whole)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: n_blocks)
    rng = random.Random(n_blocks + bucket)
    fps = set()
    for _ in range(12):  # chains around some centres, whose steps are 1 to 4 bits
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                f ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    edges = [(a % 2**64, b % 2**64) for a, b in simhash.links(df).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in edges)
    place = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        root[find(place[a])] = find(place[b])
    parts = lambda roots: sorted(sorted(i for i, r in enumerate(roots) if r == x) for x in set(roots))
    assert parts([find(i) for i in range(len(fps))]) == parts(reach(fps))


def test_blocks_grow_with_the_rows():
    assert [simhash.blocks_for(n) for n in (0, 1000, 10**9, 10**12)] == sorted(simhash.blocks_for(n) for n in (0, 1000, 10**9, 10**12))
    assert simhash.blocks_for(1000) == 4 < simhash.blocks_for(10**10)
    for k in (4, 5, 7):
        masks = simhash.block_masks(k)
        assert all(any(not d & m for m in masks) for d in ((1 << a) | (1 << b) | (1 << c) for a, b, c in [(0, 20, 40), (63, 62, 1), (15, 16, 17), (31, 32, 63)]))


# ---------------------------------------------------------------- hard negatives


def mined(rows, positives=5, negatives=10, low=30, high=90):
    """Brute force over usable (id, label, ints); rows are others of one another by place."""
    out = []
    for i, (a, label, v) in enumerate(rows):
        if a % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=True)) if len(v) == len(w) else None for _, _, w in rows]
        order = sorted((j for j in range(len(rows)) if j != i and score[j] is not None), key=lambda j: (-score[j], rows[j][0], j))
        for p in [j for j in order if rows[j][1] == label][:positives]:
            fits = [j for j in order if rows[j][1] != label and low * score[p] <= 100 * score[j] <= high * score[p]][:negatives]
            out += [(a, rows[p][0], r + 1, rows[j][0], score[p], score[j]) for r, j in enumerate(fits)]
    return sorted(out)


def usable(rows):
    return [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


@pytest.mark.parametrize(("few", "per_round", "some", "held"), [(0.15, 16384, 256, 4096), (1.1, 3, 2, 50), (0.0, 2, 256, 7)])
def test_hard_negatives(spark, monkeypatch, few, per_round, some, held):
    for name, value in (("FEW", few), ("ROUND", per_round), ("SOME", some), ("CANDIDATES", held)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (4, 8))
    rows = []
    for i in range(400):
        v = (centres[i % 4] + rng.normal(0, 0.6, 8)) * rng.choice([1, 1, 0.01, 40])
        rows.append((i * 10, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(r[0], r[1], r[2]) for r in rows[::7]]  # repeated rows, some of them anchors
    rows += [(100_000 + i, rows[0][1], 2) for i in range(30)]  # ties
    rows += [(200, None, 1), (300, [1.0] * 8, None), (400, [None] * 8, 1), (500, [float("nan")] * 8, 1), (600, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (700, [], 1), (900_000, [1.0], 0), (900_001, [2.0], 0), (900_002, [1.5], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, row int").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    assert got == mined(usable(rows)) and len(got) > 500
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()


def test_survivors_are_exact():
    rng = np.random.default_rng(0)
    for most in (1, 200, 2**20, 2**26):
        a, x = (rng.integers(-most, most, (n, 5), endpoint=True) for n in (7, 90))
        want = a @ x.T
        cut = np.sort(want, 1)[:, -4]
        r, c, score = hard_negatives.survivors(a, x, np.ones(want.shape, bool), lambda r, low, high, cut=cut: high >= (cut[:, None] if r is None else cut[r]))
        assert (score == want[r, c]).all() and {*zip(r.tolist(), c.tolist(), strict=True)} == {*zip(*(z.tolist() for z in np.nonzero(want >= cut[:, None])), strict=True)}


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_hard_negatives"])
def test_new_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    assert {tuple(r) for r in df.collect()} == set(c.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())
