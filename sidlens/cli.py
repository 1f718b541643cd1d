"""Command line: each analysis over files. `python -m sidlens.cli COMMAND --help`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import cooc, diagnose, features, learn, metrics, predictor, quality, rank, resample, sampling, transform
from .plans.session import session, with_index, written
from .sources import readers, writers


def typed(rows: DataFrame) -> DataFrame:
    """(row_id, u, target, hist) of typed interactions."""
    return rows.select("row_id", F.col("user_id").alias("u"), F.col("item_id").alias("target"), F.col("history_ids").alias("hist"))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, u, target, hist) of a split."""
    return typed(readers.interactions(spark, path))


def beam_of(spark: SparkSession, result: str, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(row_id, target, output, predict): a result file beside the split it belongs to; raises where they differ in length."""
    r = readers.paired_split(rows.select("row_id", "target"), readers.results(spark, result).select("row_id", "predict"))
    return written(r.join(catalog.select(F.col("item").alias("target"), F.col("sid").alias("output")), "target", "left").select("row_id", "target", "output", "predict"), "beam")


def result_beam(spark: SparkSession, result: str) -> DataFrame:
    """A result file by itself: the target is what the file says."""
    return readers.results(spark, result).select("row_id", "output", "predict")


def table(name: str, columns: list[str], rows: list[dict]) -> str:
    """Columns side by side under their names, numbers to the right; one row alone as a list of names and values."""
    said = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    cells = [[said(r[c]) for c in columns] for r in rows]
    if len(rows) == 1:
        wide = max(map(len, columns))
        return "\n".join([name, *(f"  {c:<{wide}}  {v}" for c, v in zip(columns, cells[0], strict=True))])
    wide = [max(len(x[i]) for x in [columns, *cells]) for i in range(len(columns))]
    right = [all(isinstance(r[c], (int, float, type(None))) for r in rows) for c in columns]
    line = lambda x: "  " + "  ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(x, wide, right, strict=True)).rstrip()
    return "\n".join([name, line(columns), *map(line, cells)])


def show(df: DataFrame, args, name: str = "report") -> None:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    print(table(name, df.columns, rows) if args.tables else json.dumps({name: rows}, indent=2, ensure_ascii=False, default=str))
    if args.json_out:
        writers.report(df, f"{args.json_out}/{name}")


def _catalog(spark, args) -> DataFrame:
    return written(readers.catalog(spark, args.index, args.item_meta), "catalog")


def _code_hits(beam: DataFrame, k: int) -> DataFrame:
    return beam.select("row_id", F.coalesce(metrics.code_rank(F.col("predict"), F.col("output")) < k, F.lit(False)).cast("int").alias("hit"))


def _strict(beam: DataFrame, catalog: DataFrame, k: int, protocol: str = "strict") -> DataFrame:
    return metrics.hit_columns(beam, catalog, k).select("row_id", F.col(protocol).alias("hit"))


def prepare(spark, a):
    good, bad = readers.sid_csv(spark, a.source)
    if wrong := bad.limit(1).collect():
        raise SystemExit(f"line {wrong[0]['line']}: {wrong[0]['error']}")
    writers.examples(good, a.output)


def train(spark, a):
    good, bad = readers.examples_jsonl(spark, a.examples)
    if wrong := bad.orderBy("line").limit(1).collect():
        raise SystemExit(f"line {wrong[0]['line']}: {wrong[0]['error']}")
    vocab = predictor.vocabulary(good)
    net, report = predictor.train(good, vocab, a.epochs, a.dim, a.heads, a.batch_size, a.lr, a.seed)
    print(json.dumps(report))
    if a.output:
        writers.predictor(spark, net, vocab, report, a.output)


def check_predictions(spark, a):
    beam, known = result_beam(spark, a.result), readers.info_file(spark, a.info).select("sid")
    show(metrics.audit(beam, known), a, "audit")
    show(metrics.hr_ndcg(beam), a, "metrics")
    show(metrics.illegal_examples(beam, known), a, "illegal")


def item_level_eval(spark, a):
    c, rows = _catalog(spark, a), rows_of(spark, a.csv)
    show(metrics.item_level(beam_of(spark, a.result, rows, c), c, a.topk), a)


def product_level_eval(spark, a):
    c, rows = _catalog(spark, a), rows_of(spark, a.csv)
    show(metrics.product_level(beam_of(spark, a.result, rows, c), c, a.topk), a)


def compare_results(spark, a):
    pairs = written(metrics.paired(_code_hits(result_beam(spark, a.a), a.topk), _code_hits(result_beam(spark, a.b), a.topk)))
    show(metrics.paired_table(pairs), a, "table")
    show(resample.paired_bootstrap(pairs, a.rounds), a, "bootstrap")


def compare_item_level(spark, a):
    rows, ca, cb = rows_of(spark, a.csv), readers.catalog(spark, a.index), readers.catalog(spark, a.index_b)
    x, y = (_strict(beam_of(spark, r, rows, c), c, a.topk) for r, c in ((a.a, ca), (a.b, cb)))
    pairs = written(metrics.paired(x, y))
    show(metrics.paired_table(pairs), a, "table")
    show(resample.paired_bootstrap(pairs, a.rounds), a, "bootstrap")


def check_collision_confound(spark, a):
    rows, ca, cb = rows_of(spark, a.csv), readers.catalog(spark, a.index), readers.catalog(spark, a.index_b)
    x, y = beam_of(spark, a.a, rows, ca), beam_of(spark, a.b, rows, cb)
    show(metrics.collision_confound(x, y, ca, cb, a.topk), a)
    show(resample.subset_bootstraps(diagnose.hits_of(metrics.collision_rows(x, y, ca, cb, a.topk)), diagnose.SUBSETS, a.rounds), a, "bootstrap")


def analyze_sid(spark, a):
    c = _catalog(spark, a)
    show(C.sid_space(c), a, "space")
    show(C.codebook_usage(c), a, "usage")
    show(C.codebook_top(c), a, "codes")
    show(C.unused_codes(c), a, "unused")
    show(C.collision_groups(c), a, "groups")
    if a.info:
        show(C.info_stats(readers.info_file(spark, a.info, titles=True)), a, "info")
    if a.csv:
        show(C.test_set_stats(rows_of(spark, a.csv), c), a, "test")


def analyze_sid_quality(spark, a):
    c, rows = _catalog(spark, a), rows_of(spark, a.train_csv)
    st = written(quality.states(rows, c, a.level), "states")
    show(written(quality.report(rows, st, a.level), "quality"), a, "quality")
    show(quality.co_prefix_rate(st, a.level), a, "co_prefix")
    show(quality.majority_accuracy(st), a, "majority_level")
    show(quality.majority_accuracy(st, "x_full"), a, "majority_full")
    show(quality.heldout_majority(with_index(st.select("row_id", "x", "y"), "row_id")), a, "heldout")
    show(quality.information(st), a, "information")
    if a.item_meta:
        # No drawn pairs: all of them.
        show(quality.sampled_title_coherence(c, a.level, a.pairs) if a.pairs else quality.title_coherence(c, a.level), a, "titles")


def _seeds(spark, a, protocol):
    if not len(a.labels) == len(a.results_a) == len(a.results_b):
        raise SystemExit("labels and results differ in number")
    rows, ca = rows_of(spark, a.csv), _catalog(spark, a)
    cb = readers.catalog(spark, a.index_b, a.item_meta)
    rows_b = rows_of(spark, a.csv_b) if a.csv_b else rows
    if a.csv_b and (wrong := metrics.order_mismatches(rows, rows_b).limit(1).collect()):
        raise SystemExit(f"the splits differ in row {wrong[0]['row_id']}")
    out = None
    for i, (ra, rb) in enumerate(zip(a.results_a, a.results_b, strict=True)):
        p = metrics.paired(_strict(beam_of(spark, ra, rows, ca), ca, a.topk, protocol), _strict(beam_of(spark, rb, rows_b, cb), cb, a.topk, protocol)).select(F.lit(i).alias("sidx"), F.lit(a.labels[i]).alias("label"), "*")
        out = p if out is None else out.union(p)
    out = written(out, "seeds")
    subsets = {"": out}
    if protocol == "strict":
        subsets["_kept"] = out.join(metrics.unique_in_both(rows, ca, cb), "row_id", "left_semi")
    for name, rows in subsets.items():
        pairs = written(rows, "pairs")
        show(resample.seed_means(pairs, "label"), a, f"seeds{name}")
        diffs = pairs.groupBy("label").agg((F.avg("b") - F.avg("a")).alias("diff"))
        show(resample.seed_summary(diffs, protocol == "product"), a, f"summary{name}")
        show(resample.two_stage_bootstrap(pairs, a.rounds), a, f"bootstrap{name}")
    # By label, one interval a seed.
    show(resample.subset_bootstraps(out.select(F.col("label").alias("subset"), "row_id", "a", "b"), a.labels, a.rounds), a, "seed_intervals")


def analyze_seeds(spark, a):
    _seeds(spark, a, "strict")


def analyze_seeds_product(spark, a):
    _seeds(spark, a, "product")


def diagnose_shared_rows(spark, a):
    if not len(a.labels) == len(a.results_a) == len(a.results_b):
        raise SystemExit("labels and results differ in number")
    rows, ca, cb = rows_of(spark, a.csv), _catalog(spark, a), readers.catalog(spark, a.index_b)
    show(diagnose.top_targets(rows, ca, cb), a, "targets")
    show(diagnose.shared_group_sizes(rows, ca), a, "sizes")
    show(diagnose.shared_rows({i: (beam_of(spark, x, rows, ca), beam_of(spark, y, rows, cb)) for i, (x, y) in enumerate(zip(a.results_a, a.results_b, strict=True))}, ca, cb, a.topk), a, "hits")


def popularity_diagnostic(spark, a):
    c, rows = _catalog(spark, a), rows_of(spark, a.csv)
    show(diagnose.popularity_buckets(beam_of(spark, a.result, rows, c), c, rows_of(spark, a.train_csv), a.topk), a)


def history_copy_diagnostic(spark, a):
    c, rows = _catalog(spark, a), rows_of(spark, a.csv)
    show(diagnose.history_copy(beam_of(spark, a.result, rows, c), rows, c), a)


def analyze_rl_curve(spark, a):
    out = None
    for path in a.logs:
        # Logs of one file name are told apart by path.
        c = diagnose.metric_curve(readers.metric_log(spark, path).select(F.lit(path).alias("log"), "step", F.col(f"`{a.metric}`").alias("hr10")))
        out = c if out is None else out.union(c)
    out = written(out, "curves")
    show(out, a, "curve")
    show(diagnose.curve_summary(out), a, "summary")


def make_subsets(spark, a):
    for split, n in (("train", a.train), ("valid", a.valid), ("test", a.test)):
        writers.split_csv(sampling.subset(readers.split_csv(spark, readers.split_file(spark, a.src_root, split)), n, a.seed), f"{a.out_dir}/{split}" + ".csv" * a.one_file)


def remap_sids(spark, a):
    index, bad = written(readers.catalog(spark, a.index, a.item_meta), "catalog"), 0
    for split in ("train", "valid", "test"):
        raw = written(readers.split_csv(spark, readers.split_file(spark, a.src_root, split)), "split")
        new, report = transform.remapped(raw, typed(readers.typed(raw)), index)
        writers.split_csv(new, f"{a.out_dir}/{split}" + ".csv" * a.one_file)
        report = written(report, "report")
        show(report, a, split)
        bad += report.first()["n_rows"] - report.first()["kept"]
    writers.info_file(C.info_table(index), f"{a.out_dir}/info" + ".txt" * a.one_file)
    if bad:
        raise SystemExit(1)


def _variant(spark, a, base, orders, c, column="new_rank"):
    k = a.topk
    new = metrics.hit_columns(rank.reordered(base, orders, column), c, k).select("row_id", F.col("strict").alias("hit"))
    pairs = metrics.paired(_strict(base, c, k), new)
    rows = rows_of(spark, a.csv).select("row_id", F.col("u").alias("cluster"))
    pairs = written(pairs.join(rows, "row_id"), "pairs")
    return resample.paired_bootstrap(pairs, a.rounds, 13).withColumn("interval", F.lit("rows")).union(resample.cluster_bootstrap(pairs, a.rounds).withColumn("interval", F.lit("users")))


def rerank_cooccurrence(spark, a):
    c, rows, tr = _catalog(spark, a), rows_of(spark, a.csv), rows_of(spark, a.train_csv)
    beam = beam_of(spark, a.result, rows, c)
    for name, orders in (("cooccurrence", rank.by_cooccurrence(beam, rows, tr, c, 2)), ("popularity", rank.by_popularity(beam, tr, c))):
        orders = written(rank.fused(orders), name)
        show(_variant(spark, a, beam, orders, c), a, name)
        show(_variant(spark, a, beam, orders, c, "fused_rank"), a, f"{name}_fused")


def rerank_probe(spark, a):
    c, rows = _catalog(spark, a), rows_of(spark, a.csv)
    beam = beam_of(spark, a.result, rows, c)
    orders = written(rank.fused(rank.by_similarity(beam, rows, readers.npy_vectors(spark, a.embeddings), c)), "similarity")
    show(_variant(spark, a, beam, orders, c), a, "similarity")
    show(_variant(spark, a, beam, orders, c, "fused_rank"), a, "fused")


def rerank_learned(spark, a):
    c, tr = _catalog(spark, a), rows_of(spark, a.train_csv)
    st = features.Stats(tr, c)
    if a.mode == "fit":
        if a.pool_mode not in ("mixed", "beamlike"):
            raise SystemExit(f"unknown pool mode {a.pool_mode}")
        own = tr.where(F.size("hist") > 0)
        own = own.where(F.col("row_id") < a.limit_rows) if a.limit_rows else own
        names = a.features.split(",") if a.features else list(features.POINTWISE)
        if unknown := set(names) - set(features.POINTWISE):
            raise SystemExit(f"unknown feature {min(unknown)}")
        samples = written(sampling.fresh_examples(own, tr, st.ppmi, a.epochs + 1, a.negatives, a.seed, a.pool_mode), "samples")
        model = learn.fit_pointwise(written(learn.pointwise_examples(samples, tr, st), "examples"), names, a.lr, a.l2)
        model |= {"train_csv": a.train_csv, "neg_per_pos": a.negatives, "epochs": a.epochs, "seed": a.seed, "pool_mode": a.pool_mode}
        print(json.dumps(model))
        return writers.model(spark, model, a.model)
    rows = rows_of(spark, a.csv)
    beam = beam_of(spark, a.result, rows, c)
    if a.mode == "ceiling":
        return show(cooc.recall_ceiling(rows, st.ppmi, beam, c), a)
    config = readers.json_object(spark, a.config) if a.mode == "apply" and a.config else {}
    # What is given beats what the configuration says, and that beats the defaults.
    given = lambda value, name, default: value if value is not None else config.get(name, default)
    models, augment = given(a.model, "model", None), given(a.augment, "augment", 0)
    if not models:
        raise SystemExit("pass --model or record it in the config file")
    config |= {"model": models, "augment": augment, "lambda": given(a.lam, "lambda", 0.0), "rrf_k": given(a.rrf_k, "rrf_k", 10)}
    found = written(features.by_sid(beam, rows, st), "features")
    scores, loaded = {}, {}
    for path in models.split(","):  # several models in one grid
        model = loaded[path] = readers.reranker(spark, path)
        s = learn.scored(found, model)
        # SIDs from outside the beam take part in selection and application.
        scores[path] = written(learn.with_augmented(s, rank.augmented(beam, rows, st, model, augment)) if augment else s, "scores")
    if a.mode == "select":
        cells = written(learn.model_grid(beam, scores, c, a.topk), "grid")
        alone = {path: {r["variant"]: r.asDict() for r in learn.protocol_scores(beam, s, c, k=a.topk).collect()} for path, s in scores.items()}
        for path, s in scores.items():
            show(metrics.reachability(rank.reordered(beam, s, "rank"), c), a, "ceiling")
        show(cells, a, "grid")
        show(best := learn.selected(cells), a, "selected")
        n = beam.count()
        chosen = best.first().asDict()
        path = chosen["model"]
        base = alone[next(iter(scores))]["base"]
        config = {"model": path, "features": loaded[path]["features"], "lambda": chosen["lam"], "rrf_k": chosen["rrf_k"], "augment": augment, "selected_on": a.csv, "strict_hr": round(chosen["strict_hits"] / max(n, 1), 6), "product_hr": round(chosen["product_hits"] / max(n, 1), 6), "learned_only_strict_hr": alone[path]["learned"]["strict_hr"], "baseline_strict_hr": base["strict_hr"], "baseline_code_hr": base["code_hr"], "grid_size": cells.count()}
        if a.config:
            writers.model(spark, config, a.config)
        if a.grid_out:
            writers.model(spark, {"baseline": base, "learned_only": {p: x["learned"] for p, x in alone.items()}, "grid": [r.asDict() for r in cells.orderBy(F.desc("strict_hits"), "model", "lam", "rrf_k").collect()], "selected": config}, a.grid_out)
        return None
    for s in scores.values():
        print(json.dumps({"label": a.label, "config": config}))
        show(learn.compare(beam, s, c, config["lambda"], config["rrf_k"], a.topk), a, "compare")
        show(learn.protocol_scores(beam, s, c, config["lambda"], config["rrf_k"], a.topk), a, "scores")
        users = rows.select("row_id", F.coalesce(F.col("u").cast("string"), F.concat(F.lit("row "), "row_id")).alias("cluster"))
        show(learn.comparison(beam, rank.fused(s, lam=config["lambda"], k=config["rrf_k"]), c, users, k=a.topk, rounds=a.rounds), a, "intervals")


def rerank_listwise(spark, a):
    c, tr, rows = _catalog(spark, a), rows_of(spark, a.train_csv), rows_of(spark, a.csv)
    beam = beam_of(spark, a.result, rows, c)
    f = written(features.listwise(beam, rows, features.Stats(tr, c)), "listwise")
    if a.mode == "train":
        model = learn.fit_listwise(f, features.LISTWISE)
        print(json.dumps(model))
        return writers.model(spark, model, a.model)
    config = readers.json_object(spark, a.config) if a.mode == "apply" and a.config else {}
    given = lambda value, name, default: value if value is not None else config.get(name, default)
    config |= {"model": given(a.model, "model", None), "subset": given(a.subset, "subset", "all"), "lambda": given(a.lam, "lambda", 1.0), "rrf_k": given(a.rrf_k, "rrf_k", 10)}
    if not config["model"]:
        raise SystemExit("pass --model or record it in the config file")
    full = readers.reranker(spark, config["model"])
    if a.mode == "select":
        cells = written(learn.subset_grid(beam, f, full, c, a.topk), "subsets")
        show(cells, a, "grid")
        show(best := learn.selected_subset(cells, list(features.SUBSETS)), a, "selected")
        chosen = best.first().asDict()
        config |= {"subset": chosen["subset"], "features": list(features.SUBSETS[chosen["subset"]]), "selected_on": a.csv, "selected": chosen}
        if a.config:
            writers.model(spark, config, a.config)
        if a.grid_out:
            writers.model(spark, {"grid": [r.asDict() for r in cells.collect()], "selected": config}, a.grid_out)
        return None
    scores = written(learn.scored(f, learn.subset_model(full, features.SUBSETS[config["subset"]])), "scores")
    print(json.dumps({"label": a.label, "config": config}))
    show(learn.compare(beam, scores, c, config["lambda"], config["rrf_k"], a.topk), a, config["subset"])
    return show(learn.protocol_scores(beam, scores, c, config["lambda"], config["rrf_k"], a.topk), a, "scores")


#: The options of each command beside --json-out, --topk and --rounds.
COMMANDS = {
    prepare: "source output",
    train: "examples output? epochs=5 dim=64 heads=4 batch-size=128 lr=0.001 seed=42",
    check_predictions: "result info",
    item_level_eval: "result index csv item-meta?",
    product_level_eval: "result index csv item-meta",
    compare_results: "a b",
    compare_item_level: "a b index index-b csv",
    check_collision_confound: "a b index index-b csv",
    analyze_sid: "index item-meta? csv? info?",
    analyze_sid_quality: "index train-csv item-meta? level=1 pairs=100000",
    analyze_seeds: "labels* results-a* results-b* index index-b csv csv-b? item-meta?",
    analyze_seeds_product: "labels* results-a* results-b* index index-b csv csv-b? item-meta",
    diagnose_shared_rows: "labels* results-a* results-b* index index-b csv item-meta?",
    popularity_diagnostic: "result index csv train-csv item-meta?",
    history_copy_diagnostic: "result index csv item-meta?",
    analyze_rl_curve: "logs* metric=hr@10",
    make_subsets: "src-root out-dir train=1000 valid=1000 test=1000 seed=42 one-file=0",
    remap_sids: "src-root index out-dir item-meta one-file=0",
    rerank_cooccurrence: "result index csv train-csv item-meta?",
    rerank_probe: "result index csv embeddings item-meta?",
    rerank_learned: "mode model? result? index csv? train-csv item-meta? negatives=12 epochs=4 lr=0.15 l2=0.00001 features? pool-mode=mixed limit-rows=0 seed=42 augment?int lam?float rrf-k?int config? grid-out? label=",
    rerank_listwise: "mode model? result index csv train-csv item-meta? subset? lam?float rrf-k?int config? grid-out? label=",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sidlens")
    sub = top.add_subparsers(dest="command", required=True)
    for f, options in COMMANDS.items():
        p = sub.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        for o in options.split():
            if o.endswith(("?int", "?float")):
                name, kind = o.split("?")
                p.add_argument(f"--{name}", type={"int": int, "float": float}[kind], default=None)
            elif "=" in o:
                name, value = o.split("=")
                kind = int if value.lstrip("-").isdigit() else float if value.replace(".", "").isdigit() else str
                p.add_argument(f"--{name}", type=kind, default=kind(value))
            elif o.endswith("*"):
                p.add_argument(f"--{o[:-1]}", nargs="+", required=True)
            else:
                p.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
        p.add_argument("--json-out", default=None)
        p.add_argument("--tables", type=int, default=0, help="1: tables instead of JSON")
        p.add_argument("--topk", type=int, default=10)
        p.add_argument("--rounds", type=int, default=2000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or session(), args)


if __name__ == "__main__":
    main()
