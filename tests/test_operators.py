import numpy as np
import pyarrow
import pytest
from pyspark.sql import functions as F

from sidlens.operators import blocks, catalog, cooc, diagnose, features, learn, metrics, predictor, quality, rank, resample, sampling, transform, trie
from sidlens.plans import queries as plans
from sidlens.plans.fixtures import Fixtures
from sidlens.plans.session import with_index, with_running, written

A, B, C, X = "<a_1><b_1><c_1>", "<a_1><b_2><c_1>", "<a_2><b_1><c_1>", "<a_9><b_9><c_9>"


@pytest.fixture(scope="module")
def cat(spark):
    # A decodes to items 1 and 2 of two products, B to 3, C to 4 and 5 of one product.
    return spark.createDataFrame([(1, A, "red mug"), (2, A, "Blue  mug"), (3, B, "red mug"), (4, C, "pen"), (5, C, "PEN")], "item int, sid string, title string")


def beam_of(spark, *rows):
    return spark.createDataFrame([(i, t, o, p) for i, (t, o, p) in enumerate(rows)], "row_id long, target int, output string, predict array<string>")


def test_first_hits(spark, cat):
    b = beam_of(spark, (3, B, [X, A, B]), (1, A, [B, A]), (4, C, [C]), (99, None, [A]), (3, B, []))
    r = {x["row_id"]: x for x in metrics.first_hits(b, cat).collect()}
    assert (r[0]["code_pos"], r[0]["strict_pos"], r[0]["fraction"]) == (2, 2, 1)
    # A, which holds the product among others, ends the search for it ...
    assert (r[0]["product_pos"], r[0]["product_fraction"]) == (None, 0.5)
    assert (r[1]["code_pos"], r[1]["strict_pos"], r[1]["fraction"], r[1]["product_pos"]) == (1, None, 0.5, 0)
    assert (r[2]["strict_pos"], r[2]["product_pos"]) == (None, 0)
    assert r[3]["code_pos"] is None and r[3]["ambiguous_target"] and not r[3]["unique_target"]
    assert r[4]["code_pos"] is None
    # ... unless the scan goes on, and an ambiguous target has no product under the other rule.
    on = {x["row_id"]: x["product_pos"] for x in metrics.first_hits(b, cat, stop_at_ambiguous=False).collect()}
    other = {x["row_id"]: x["product_pos"] for x in metrics.first_hits(b, cat, own_key=False).collect()}
    assert on[0] == 2 and other[1] is None


def test_cutoff_and_audit(spark, cat):
    b = beam_of(spark, (3, B, [X, B, B, ""]))
    assert metrics.first_hits(b, cat, k=1).first()["code_pos"] is None
    a = metrics.audit(b, cat).first()
    assert (a["n_predictions"], a["illegal_sids"], a["wrong_length"], a["duplicates"], a["empty_predictions"]) == (4, 2, 1, 1, 1)
    # X has no token of the catalog, the mixed SID only such; the empty candidate has no token.
    b = beam_of(spark, (3, B, [X, "<a_2><b_2><c_1>", A, ""]))
    a = metrics.audit(b, cat).first()
    assert (a["illegal_sids"], a["illegal_tokens"]) == (3, 1)


def test_split_order_and_kept(spark, cat):
    rows = lambda *t: spark.createDataFrame(list(enumerate(t)), "row_id long, target int")
    assert metrics.order_mismatches(rows(1, 2, None), rows(1, 2, None)).count() == 0
    assert sorted(map(tuple, metrics.order_mismatches(rows(1, 2, 3), rows(1, 3)).collect())) == [(1, 2, 3), (2, 3, None)]
    other = spark.createDataFrame([(i, f"<a_{i}><b_0><c_0>", "") for i in (1, 2, 3, 4)], "item int, sid string, title string")
    # 1 and 4 share a SID in the first catalog, 5 is unknown to the second; 99 to both.
    assert [r["row_id"] for r in metrics.unique_in_both(rows(1, 3, 4, 5, 99, 3), cat, other).orderBy("row_id").collect()] == [1, 5]


def test_curves_and_info(spark):
    log = spark.createDataFrame([("x", 0, 0.1), ("x", 10, 0.3), ("x", 20, 0.2), ("y", 0, 0.4), ("y", 5, 0.2)], "log string, step int, hr10 double")
    s = diagnose.curve_summary(diagnose.metric_curve(log)).first()
    assert tuple(s) == (2, 0.25, 0.35, 0.2, 1)
    assert tuple(catalog.info_stats(spark.createDataFrame([(A,), (A,), (A,), (B,)], "sid string")).first()) == (4, 2, 2)
    assert tuple(catalog.info_stats(spark.createDataFrame([], "sid string")).first()) == (0, 0, 0)


def test_sampled_titles(spark):
    # Items of a prefix share two of their three words, of different prefixes none.
    rows = [(i, f"<a_{i % 4}><b_{i}><c_0>", f"group{i % 4} kind{i % 4} item{i}") for i in range(40)]
    c = spark.createDataFrame(rows, "item int, sid string, title string")
    assert tuple(quality.sampled_title_coherence(c, n_pairs=500).first()) == (500, 500, 0.5, 0.0, 0.5)
    assert tuple(quality.sampled_title_coherence(c.where("item % 4 = 0"), n_pairs=50).first()) == (50, 0, 0.5, None, None)
    assert tuple(quality.sampled_title_coherence(c.where("item < 4"), n_pairs=50).first()) == (0, 50, None, 0.0, None)
    assert tuple(quality.sampled_title_coherence(c.where("item < 0")).first())[:2] == (0, 0)


def test_beamlike_negatives(spark):
    train = spark.createDataFrame([(i, i % 5, [(i + 1) % 5, (i + 2) % 5]) for i in range(20)] + [(20, 3, [])], "row_id long, target int, hist array<int>")
    p = cooc.ppmi(train)
    got = sampling.beamlike_negatives(train, train, p, per_row=6).collect()
    target = {r["row_id"]: r["target"] for r in train.collect()}
    assert {r["row_id"] for r in got} == set(range(20)) and all(r["item"] != target[r["row_id"]] for r in got)
    assert len({tuple(r) for r in got}) == len(got)


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    want, total = {}, 0
    for r in df.orderBy("k").collect():
        want[r["k"]] = total = total + r["v"]
    assert {r["k"]: r["s"] for r in with_running(df, F.col("v"), "k", name="s").collect()} == want


def test_empty_beam(spark, cat):
    b = beam_of(spark)
    assert metrics.item_level(b, cat).count() == 0
    assert metrics.audit(b, cat).first()["duplicates"] == 0


def test_paired_needs_equal_rows(spark):
    h = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "row_id long, hit int")
    assert metrics.paired_table(metrics.paired(h(1, 2), h(1, 2))).first()["both_hit"] == 2
    with pytest.raises(Exception, match="different rows"):
        metrics.paired(h(1, 2), h(1)).collect()


def test_archived_identities(spark):
    n = {"only_a": 149, "only_b": 108, "both": 402, "neither": 3874}
    pairs = spark.createDataFrame([("only_a", 1, 0), ("only_b", 0, 1), ("both", 1, 1), ("neither", 0, 0)], "k string, a int, b int")
    pairs = pairs.join(spark.createDataFrame(list(n.items()), "k string, n int"), "k").select(F.explode(F.array_repeat(F.lit(1), F.col("n"))), "a", "b")
    t = metrics.paired_table(pairs).first()
    assert (t["n_rows"], t["net"], t["hr_a"], t["hr_b"]) == (4533, -41, 0.121553, 0.112508)
    s = resample.seed_summary(spark.createDataFrame([(0.012795,), (0.021399,), (0.042577,)], "diff double")).first()
    assert (round(s["mean"], 5), round(s["sd"], 6), round(s["t"], 3), s["p"], s["same_sign"]) == (0.02559, 0.015327, 2.892, 0.1017, True)
    s = resample.seed_summary(spark.createDataFrame([(-0.024046,), (-0.012133,), (0.008604,)], "diff double"), True).first()
    assert (round(s["t"], 3), s["p"], s["same_sign"]) == (-0.964, 0.4369, False)
    assert resample.seed_summary(spark.createDataFrame([(0.1,)], "diff double")).first()["sd"] is None


def test_binomials_are_binomial():
    for n, c, m in ((0, 1, 3), (5, 0, 3), (7, 3, 3), (130, 1, 2), (130, 2, 7), (61, 99, 100)):
        drawn = np.array([resample.binomial(f"x|{i}", n, c, m) for i in range(3000)])
        p = c / m
        assert drawn.min() >= 0 and drawn.max() <= n
        assert abs(drawn.mean() - n * p) <= 4 * (n * p * (1 - p) / 3000) ** 0.5
        assert abs(drawn.var() - n * p * (1 - p)) <= 0.15 * n * p * (1 - p)
    assert resample.binomial("large", 2**20, 2**61, 2**62) == resample.ones("large|0", 2**20)


def test_splits_share_out_all_draws():
    before = np.concatenate(([0], np.cumsum(np.arange(1, 101)))).tolist()
    whole = dict(resample.splits("k", 500, lambda i: before[i], 0, 100))
    assert sum(whole.values()) == 500
    parts = dict(resample.splits("k", 500, lambda i: before[min(100, -(-i // 8) * 8)], 0, 100, 8))
    again = {i: n for lo, n in parts.items() for i, n in resample.splits("k", n, lambda i: before[i], lo, min(lo + 8, 100))}
    assert again == whole and {lo: sum(n for i, n in whole.items() if lo <= i < lo + 8) for lo in parts} == parts
    counts = np.zeros(100)
    for k in range(400):
        for i, n in resample.splits(str(k), 5050, lambda i: before[i], 0, 100):
            counts[i] += n
    assert np.abs(counts / 400 - np.arange(1, 101)).max() < 2.5  # five deviations of the mean at the most frequent


def test_bootstraps(spark, monkeypatch):
    rows = [(i, i % 5, int(i % 3 == 0), int(i % 2 == 0)) for i in range(400)]
    pairs = spark.createDataFrame(rows, "row_id long, cluster long, a int, b int")
    d = np.array([b - a for _, _, a, b in rows])
    x = resample.paired_bootstrap(pairs, 1000).first()
    means = np.sort(np.random.default_rng(0).choice(d, (1000, 400)).mean(1))
    assert x["n_rows"] == 400 and x["diff"] == round(d.mean(), 6)
    assert abs(x["ci_lo"] - means[25]) < 0.02 and abs(x["ci_hi"] - means[974]) < 0.02
    weighted = pairs.withColumn("b", F.col("b") + F.col("row_id"))  # as many groups as rows
    parts = [resample.paired_bootstrap(weighted, 50).first()]
    users = [resample.cluster_bootstrap(weighted, 50).first()]
    monkeypatch.setattr(resample, "PART", 16)
    parts.append(resample.paired_bootstrap(weighted, 50).first())
    users.append(resample.cluster_bootstrap(weighted, 50).first())
    assert parts[0] == parts[1] and users[0] == users[1]
    none = resample.paired_bootstrap(pairs.limit(0), 20).first()
    assert none["n_rows"] == 0 and none["diff"] is None
    sets = pairs.select(F.when(F.col("row_id") < 100, "x").otherwise("y").alias("subset"), "a", "b")
    got = {r["subset"]: r for r in resample.subset_bootstraps(sets, ["y", "none", "x"], 40).collect()}
    assert {k: r["n_rows"] for k, r in got.items()} == {"x": 100, "y": 300}
    two = pairs.select((F.col("row_id") % 2).cast("int").alias("sidx"), "a", "b")
    r = resample.two_stage_bootstrap(two, 200).first()
    assert r["n_rows"] == 400 and r["ci_lo"] <= r["diff"] <= r["ci_hi"]


def test_with_index(spark):
    rows = with_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "k").orderBy("k").collect()
    assert [r["idx"] for r in rows] == list(range(1000))


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "row_id long, target int, hist array<int>")


def test_cooccurrence(spark):
    r = rows_of(spark, (5, [1, 2, 2]), (5, [1, 2, 3]), (4, [3]), (4, []))
    assert {tuple(x) for x in cooc.pair_counts(r).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
    p = {(x["a"], x["b"]): x["ppmi"] for x in cooc.ppmi(r).collect()}
    assert p[1, 2] == pytest.approx(np.log(2 * 4 / 4), abs=1e-9) and (1, 3) not in p
    # Histories of one item count among the marginals only where the least length is one: here 4 / (2 * 2) is 1, there 4 / (2 * 1).
    assert {(x["a"], x["b"]) for x in cooc.ppmi(r, 2).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert [tuple(x) for x in cooc.popular(r).collect()] == [(5, 2, 1), (4, 2, 2)]


def test_ties_and_lambda_zero(spark):
    s = spark.createDataFrame([(1, "x", 0, 0.5), (1, "y", 1, 0.5), (1, "z", 2, 0.9)], "row_id long, sid string, rank int, score double")
    r = rank.ranked(s, "score")
    assert {x["sid"]: x["new_rank"] for x in r.collect()} == {"z": 0, "x": 1, "y": 2}
    assert all(x["fused_rank"] == x["rank"] for x in rank.fused(r, lam=0).collect())


def test_quality(spark, cat):
    r = rows_of(spark, (1, [1, 3, 4]), (2, [2, 4]), (3, [99]), (99, [1]), (4, [5, 5]))
    st = quality.states(r, cat)
    assert st.count() == 3
    x = quality.co_prefix_rate(st).first()
    assert (x["pairs"], x["same"]) == (5, 2)
    i = quality.information(st).first()
    assert i["mi"] >= 0 and i["nmi"] is None or i["nmi"] <= 1
    assert quality.heldout_majority(spark.createDataFrame([], "idx long, x string, y string")).first()["accuracy"] is None
    one = cat.where("item = 1")
    assert quality.title_coherence(one).first()["gain"] is None


def test_quality_report(spark, cat):
    index = spark.createDataFrame([(1, A), (2, B), (3, C)], "item int, sid string")
    r = rows_of(spark, (1, [2, 3, 2]), (9, [2]), (1, [9]), (2, []), (3, [9, 3]))
    x = quality.report(r, quality.states(r, index)).first()
    assert (x["n_rows"], x["used_rows"], x["co_prefix_pairs"], x["target_full_classes"], x["context_states"]) == (5, 2, 3, 2, 2)
    x = quality.report(r.limit(0), quality.states(r.limit(0), index)).first()
    assert (x["n_rows"], x["used_rows"], x["co_prefix_pairs"], x["co_prefix_pair_rate"], x["heldout_acc_level"]) == (0, 0, 0, None, None)


def test_remap_and_subset(spark):
    r = rows_of(spark, (1, [2, 3]), (9, [2]), (1, [9]), (2, []))
    index = spark.createDataFrame([(1, A), (2, B), (3, C)], "item int, sid string")
    kept = {x["row_id"]: x for x in transform.remap(r, index).collect()}
    assert set(kept) == {0, 3} and kept[0]["new_hist"] == [B, C] and kept[3]["new_hist"] in ([], [None])
    rep = transform.remap_report(r, index).first()
    assert (rep["kept"], rep["missing_targets"], rep["missing_history"], rep["examples"]) == (2, 1, 1, "9")
    assert [x["row_id"] for x in sampling.subset(r, 99).collect()] == [0, 1, 2, 3]


def test_catalog(spark, cat):
    assert catalog.sid_space(cat).first()["collision_items"] == 4
    assert [x["sid"] for x in catalog.collision_groups(cat).collect()] == [A, C]


def test_predictor(spark):
    e = spark.createDataFrame([(1, ["x/y/z", "y/z/x"], "z/x/y"), (2, ["y/z/x"], "x/y/z"), (3, [], "x/y/z"), (4, ["x/y"], "x/y/z"), (5, ["q/y/z"], "x/y/z")], "row_id long, history array<string>, target string")
    good = e.where("row_id <= 2")
    v = predictor.vocabulary(good)
    assert {r["token"]: r["id"] for r in v.collect()} == {"<pad>": 0, "x": 1, "y": 2, "z": 3}
    enc = {r["row_id"]: r for r in predictor.encoded(e, v).collect()}
    assert enc[1]["history"] == [[1, 2, 3], [2, 3, 1]] and enc[2]["history"] == [[0, 0, 0], [2, 3, 1]] and enc[1]["target"] == [3, 1, 2]
    assert [enc[i]["error"] for i in (3, 4, 5)] == ["empty history", "malformed SID", "unknown token"]
    net, report = predictor.train(good, v, epochs=30, dim=8, heads=2, rate=1e-2)
    assert report["examples"] == 2 and report["losses"][-1] < report["losses"][0]
    assert predictor.logits(good, v, net).count() == 2 * 3 * 4


def test_training_takes_all_examples(spark):
    rng = np.random.default_rng(1)
    sid = lambda: f"<a_{rng.integers(3)}><b_{rng.integers(3)}><c_{rng.integers(3)}>"
    e = spark.createDataFrame([(i, [x := sid(), sid()], x) for i in range(60)], "row_id long, history array<string>, target string")
    v = predictor.vocabulary(e)
    for shard in (100, 25):
        net, report = predictor.train(e, v, epochs=12, dim=8, heads=2, rate=1e-2, batch=16, shard=shard)
        again, _ = predictor.train(e.repartition(3), v, epochs=12, dim=8, heads=2, rate=1e-2, batch=16, shard=shard)
        assert report["examples"] == 60 and len(report["losses"]) == 12 and report["losses"][-1] < 0.9 * report["losses"][0]
        assert all(np.allclose(net.p[k], again.p[k]) for k in net.p)
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(predictor, "train", lambda *a, **k: seen.append((len(a), k)) or (None, {"losses": [1.0]}))
        plans.QUERIES["train_predictor"](spark, "/root/testdata/sf0.001")
    assert seen == [(2, {})]


def test_listwise_query_runs_the_default_epochs(monkeypatch):
    seen = []
    monkeypatch.setattr(plans, "_listwise", lambda fx: None)

    def fit(*a, **k):
        seen.append((len(a), k))
        raise StopIteration

    monkeypatch.setattr(plans.learn, "fit_listwise", fit)
    with pytest.raises(StopIteration):
        plans.QUERIES["fit_listwise"](None, "")
    assert seen == [(2, {})]


def test_gradient():
    net = predictor.Recommender(6, 8, 2, 2, 5, 1)
    rng = np.random.default_rng(0)
    h = rng.integers(1, 6, (3, 4, 3))
    h[0, :2] = 0
    t = rng.integers(1, 6, (3, 3))
    value, d = net.loss((out := net.forward(h))[0], t)
    g = net.backward(d, out[1])
    for name in net.p:
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-5
        up = net.loss(net.forward(h)[0], t)[0]
        net.p[name][at] = before - 1e-5
        down = net.loss(net.forward(h)[0], t)[0]
        net.p[name][at] = before
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], abs=1e-6), name


def test_catalog_argmax(spark, cat):
    s = spark.createDataFrame([(1, lv, c, v) for lv, c, v in (("a", 1, 5.0), ("a", 2, 1.0), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 1, 0.0))], "row_id long, level string, code int, v double")
    assert [tuple(x) for x in trie.best_sids(s, cat).collect()] == [(1, A, 5.0)]


@pytest.mark.parametrize(("shard", "k"), [(1 << 20, 1), (37, 5), (1, 3)])
def test_best_sids_of_a_trie(spark, monkeypatch, shard, k):
    monkeypatch.setattr(trie, "SHARD", shard)
    rng = np.random.default_rng(k)
    n = 12 if shard == 1 else 300
    sids = sorted({f"<a_{a}><b_{b}><c_{c}>" for a, b, c in rng.integers(0, 9, (n, 3))})
    v = {(r, x, i): float(rng.integers(0, 6)) for r in range(6) for x in "abc" for i in range(9) if (r + i) % 7}  # ties, and codes without a score
    scores = spark.createDataFrame([(*key, x) for key, x in v.items()] + [(9, "a", 1, 1.0)], "row_id long, level string, code int, v double")
    got = sorted(tuple(r)[:3] for r in trie.best_sids(scores, spark.createDataFrame([(s,) for s in [*sids, "odd/sid/x", sids[0]]], "sid string"), k=k).collect())
    want = []
    for r in range(6):
        total = {s: [v.get((r, x, int(s.split(f"<{x}_")[1].split(">")[0]))) for x in "abc"] for s in sids}
        whole = sorted((-sum(t), s) for s, t in total.items() if None not in t)
        want += [(r, s, -t) for t, s in whole[:k]]
    assert got == sorted(want)
    assert trie.best_sids(scores, spark.createDataFrame([], "sid string"), k=k).count() == 0


def test_a_trie_opens_few_nodes():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 64, (20_000, 3)), axis=0)
    t = trie.Trie(pyarrow.array([str(tuple(c)) for c in codes.tolist()]), *codes.T)
    scores = [np.sort(rng.normal(0, 1, 64) ** 3) for _ in range(3)]
    best, opened = t.best(scores, 1, [])
    assert -best[0][0] == max((scores[0][a] + scores[1][b]) + scores[2][c] for a, b, c in codes) and opened < 100


def test_descent_equals_a_plain_loop(spark, monkeypatch):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    train = fx.rows("train").where("row_id % 7 = 1")
    st = features.Stats(fx.rows("train"), fx.catalog())
    samples = written(sampling.fresh_examples(train, fx.rows("train"), st.ppmi, draws=3, per_row=4))
    examples = written(learn.pointwise_examples(samples, train, st))
    rows = sorted((tuple(r) for r in examples.select("draw", "row_id", "slot", "label", *features.POINTWISE).collect()), key=lambda r: r[:3])
    assert len(rows) == samples.count() and {r[2] for r in rows} == {-1, 0, 1, 2, 3}
    assert {r[:2] for r in rows if r[0] == 1 and r[2] >= 0} and {r[1:3] for r in rows if r[0] == 1} != {r[1:3] for r in rows if r[0] == 2}
    x = np.array([r[4:] for r in rows if r[0] == 0])
    mean, scale = x.mean(0), np.where(x.var(0) > 1e-9, x.std(0), 1.0)
    w, bias, losses = np.zeros(14), 0.0, []
    for draw in (1, 2):
        loss = seen = 0
        for r in rows:
            if r[0] == draw:
                seen += 1
                v = (np.array(r[4:]) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(bias + w @ v, -30, 30)))
                loss -= np.log(p if r[3] else 1 - p)
                step = 0.15 / np.sqrt(1 + seen / 20000)
                w, bias = w - step * ((p - r[3]) * v + 1e-5 * w), bias - step * (p - r[3])
        losses.append(loss / seen)
    monkeypatch.setattr(learn, "STEPS", 700)  # several parts a pass
    m = learn.fit_pointwise(examples)
    assert m["weights"] == pytest.approx(w.tolist(), abs=1e-9) and m["bias"] == pytest.approx(bias, abs=1e-9) and m["losses"] == pytest.approx(losses)
    assert m["losses"][1] < m["losses"][0]


def test_negatives_follow_their_weights(spark):
    train = spark.createDataFrame([(i, i % 2, [2, 3]) for i in range(40)] + [(40 + i, 9, []) for i in range(8)], "row_id long, target long, hist array<long>")
    p = cooc.ppmi(spark.createDataFrame([(0, 0, [2, 5]), (1, 0, [3, 6, 7])], "row_id long, target long, hist array<long>"))
    got = sampling.negatives(train, train, p, per_row=200).collect()
    by = {}
    for r in got:
        by.setdefault(r["row_id"], {})[r["item"]] = r["slot"]
    assert sorted(by) == list(range(40))  # no history, no negatives
    assert all(set(v) == {0, 1, 9, 2, 3, 5, 6, 7} - {k % 2} for k, v in by.items())
    assert all(len(set(v.values())) == len(v) and min(v.values()) == 0 for v in by.values() if 0 in v.values())


@pytest.mark.parametrize(("block", "some", "share"), [(1 << 16, 1 << 20, 64), (5, 7, 1)])
def test_pairs_are_looked_up(spark, monkeypatch, block, some, share):
    for name, value in (("BLOCK", block), ("SOME", some), ("PACKETS", share)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(0)
    for top in (40, 2**40):
        ids = [int(x) for x in rng.permutation(40)] if top == 40 else [int(x) for x in rng.integers(0, top, 40)]
        pairs = {(min(a, b), max(a, b)): (int(rng.integers(1, 9)), float(rng.normal())) for a, b in rng.choice(ids, (120, 2)) if a != b}
        n = {i: int(rng.integers(1, 20)) for i in ids}
        table = spark.createDataFrame([(int(a), int(b), c, n[a], n[b], v) for (a, b), (c, v) in pairs.items()], "a long, b long, c long, na long, nb long, ppmi double")
        rows = [(r, [ids[j] for j in rng.integers(0, 40, r % 9)]) for r in range(30)]
        cand = [(r, [*dict.fromkeys(ids[j] for j in rng.integers(0, 40, 8))]) for r in range(30)]
        got = blocks.matched(spark.createDataFrame([(r, i) for r, c in cand for i in c], "row_id long, item long"), spark.createDataFrame(rows, "row_id long, hist array<long>"), blocks.pair_blocks(table)).collect()
        want = {}
        for (r, h), (_, c) in zip(rows, cand, strict=True):
            for i in c:
                hit = [(pairs[min(i, j), max(i, j)], n[j]) for j in set(h) if i != j and (min(i, j), max(i, j)) in pairs]
                if hit:
                    v = [max(p, 0) for (_, p), _ in hit]
                    want[r, i] = (sum(v), max(v), sum(c / m for (c, _), m in hit), len(hit))
        assert {(r["row_id"], r["item"]): pytest.approx(tuple(r)[2:]) for r in got} == want


@pytest.mark.parametrize("block", [1024, 3])
def test_title_coherence_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    rng = np.random.default_rng(block)
    words = ["red", "blue", "green", "long", "short", "thing", "box", "of"]
    rows = [(i, f"<a_{i % 3}><b_{i}><c_0>", " ".join(rng.choice(words, rng.integers(0, 5)))) for i in range(60)]
    tokens = [{w for w in t.split() if len(w) > 2} for _, _, t in rows]
    sums = {True: [], False: []}
    for i in range(60):
        for j in range(i):
            union = tokens[i] | tokens[j]
            sums[i % 3 == j % 3].append(len(tokens[i] & tokens[j]) / len(union) if tokens[i] and tokens[j] else 0)
    w, a = np.mean(sums[True]), np.mean(sums[False])
    got = tuple(quality.title_coherence(spark.createDataFrame(rows, "item int, sid string, title string")).first())
    assert got == (len(sums[True]), len(sums[False]), round(w, 6), round(a, 6), round(w - a, 6))


def test_candidates_are_never_broadcast(spark):
    beam = spark.createDataFrame([(1, ["<a_1><b_1><c_1>", "<a_1><b_1><c_2>"])], "row_id long, predict array<string>")
    rows = spark.range(100000).select(F.col("id").alias("row_id"), F.array_repeat("id", 10).alias("hist"))
    joined = features.beam_candidates(beam).join(rows.select("row_id"), "row_id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2


@pytest.mark.parametrize("together", [1 << 22, 7])
def test_pairs_are_counted_before_they_are_shuffled(spark, monkeypatch, together):
    monkeypatch.setattr(cooc, "TOGETHER", together)
    rng = np.random.default_rng(together)
    rows = [(i, [int(x) for x in rng.integers(-3, 12, i % 7)] + [None] * (i % 5 == 0)) for i in range(60)]
    want = {}
    for _, h in rows:
        own = sorted({x for x in h if x is not None})
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "row_id long, hist array<int>")
    got = cooc.pair_counts(df)
    assert {(r["a"], r["b"]): r["c"] for r in got.collect()} == want and dict(got.dtypes)["a"] == "int"
    # Rows that share all pairs: a task sends each pair once.
    same = spark.createDataFrame([(0, [1, 2, 3])] * 50, "row_id long, items array<long>").coalesce(1).select("items").mapInArrow(cooc.counted, "a long, b long, c long")
    assert together == 7 or sorted(map(tuple, same.collect())) == [(1, 2, 50), (1, 3, 50), (2, 3, 50)]


def test_packets_are_narrow():
    for x in ([5], [], [-3, 250], [2**40, 2**40 + 70000], [-(2**62), 2**62], [0, 2**63 - 1]):
        data = blocks._binary(np.array(x, np.int64))
        assert blocks._integers(pyarrow.py_buffer(data)).tolist() == x
    assert len(blocks._binary(np.arange(2**40, 2**40 + 200))) == 9 + 200
