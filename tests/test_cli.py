import csv
import json
import random

import numpy as np
import pytest

from sidlens import cli


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("files"), random.Random(0)
    items = range(30)
    for arm, n in (("a", 9), ("b", 40)):
        (d / f"index_{arm}.json").write_text(json.dumps({str(i): [f"<a_{i % 3}>", f"<b_{i % n}>", "<c_0>"] for i in items}))
    (d / "meta.json").write_text(json.dumps({str(i): {"title": f"thing number {i % 12}"} for i in items}))
    sid = {arm: {i: f"<a_{i % 3}><b_{i % n}><c_0>" for i in items} for arm, n in (("a", 9), ("b", 40))}
    targets = {}
    for split, n in (("train", 80), ("valid", 20), ("test", 20)):
        with open(d / f"{split}.csv", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["user_id", "item_id", "item_sid", "history_item_id", "history_item_sid"])
            targets[split] = []
            for r in range(n):
                h, t = rng.choices(items, k=rng.randrange(1, 6)), rng.choice(items)
                targets[split].append(t)
                w.writerow([f"u{r % 7}", t, sid["a"][t], h, [sid["a"][i] for i in h]])
    for arm in "ab":
        for seed in (1, 2):
            rows = [{"predict": rng.sample([*dict.fromkeys([sid[arm][t], *sid[arm].values()])], 8), "output": sid[arm][t]} for t in targets["test"]]
            (d / f"result_{arm}{seed}.json").write_text(json.dumps(rows))
    (d / "info.txt").write_text("".join(f"{s}\tx\t{i}\n" for i, s in sid["a"].items()))
    np.save(d / "v.npy", np.random.default_rng(0).normal(size=(30, 4)).astype(np.float32))
    return d


def run(spark, files, capsys, line):
    cli.main([x.replace("@", f"{files}/") for x in line.split()], spark)
    return capsys.readouterr().out


COMMON = "--index @index_a.json --item-meta @meta.json"
ONE = f"--result @result_a1.json --csv @test.csv {COMMON}"
PAIR = "--a @result_a1.json --b @result_b1.json --index @index_a.json --index-b @index_b.json --csv @test.csv"
SEEDS = f"--labels 1 2 --results-a @result_a1.json @result_a2.json --results-b @result_b1.json @result_b2.json --index-b @index_b.json --csv @test.csv {COMMON}"


@pytest.mark.parametrize(
    ("line", "said"),
    [
        ("check-predictions --result @result_a1.json --info @info.txt", '"illegal_sids": 0'),
        (f"item-level-eval {ONE}", '"bucket": "all"'),
        (f"product-level-eval {ONE}", '"bucket": "all"'),
        ("compare-results --a @result_a1.json --b @result_a2.json --rounds 20", '"n_rows": 20'),
        (f"compare-item-level {PAIR} --rounds 20", '"only_a"'),
        (f"check-collision-confound {PAIR} --rounds 20", '"bootstrap"'),
        (f"analyze-sid {COMMON} --csv @test.csv --info @info.txt", '"duplicate_rows": 21'),
        (f"analyze-sid-quality {COMMON} --train-csv @train.csv", '"used_rows": 80'),
        (f"analyze-seeds {SEEDS} --csv-b @test.csv --rounds 20", '"summary_kept"'),
        (f"analyze-seeds-product {SEEDS} --rounds 20", '"n_seeds": 2'),
        (f"diagnose-shared-rows {SEEDS}", '"hits_a"'),
        (f"popularity-diagnostic {ONE} --train-csv @train.csv", '"bucket": ">100"'),
        (f"history-copy-diagnostic {ONE}", '"copy_first"'),
        (f"rerank-cooccurrence {ONE} --train-csv @train.csv --rounds 20", '"interval": "users"'),
        (f"rerank-probe {ONE} --embeddings @v.npy --rounds 20", '"similarity"'),
        (f"rerank-learned --mode ceiling {ONE} --train-csv @train.csv", '"union_hits"'),
    ],
)
def test_command(spark, files, capsys, line, said):
    assert said in run(spark, files, capsys, line)


def test_tables(spark, files, capsys):
    out = run(spark, files, capsys, f"analyze-sid {COMMON} --tables 1").splitlines()
    at = out.index("usage")
    assert out[0] == "space" and out[1].split()[0] in ("n_items", "items") and len({len(x) for x in out[at + 1 : at + 5]}) == 1
    assert cli.table("x", ["a", "b"], [{"a": 1.5, "b": "q"}, {"a": None, "b": "rst"}]) == "x\n    a  b\n  1.5  q\n    -  rst"


def test_other_order_is_refused(spark, files, capsys):
    with pytest.raises(SystemExit, match="differ in row"):
        run(spark, files, capsys, f"analyze-seeds {SEEDS} --csv-b @valid.csv --rounds 20")


def test_learned(spark, files, capsys):
    model = json.loads(run(spark, files, capsys, f"rerank-learned --mode fit --model @m {COMMON} --train-csv @train.csv --negatives 2 --epochs 2"))
    assert len(model["losses"]) == 2 and model["epochs"] == 2 and len(model["weights"]) == 14
    run(spark, files, capsys, f"rerank-learned --mode fit --model @m2 {COMMON} --train-csv @train.csv --pool-mode beamlike --limit-rows 40 --epochs 1 --features ppmi_sum,pop_log")
    assert '"code_ceiling"' in run(spark, files, capsys, f"rerank-learned --mode select --model @m,@m2 {ONE} --train-csv @train.csv --augment 2 --config @config --grid-out @grid")
    config, grid = (cli.readers.json_object(spark, f"{files}/{x}") for x in ("config", "grid"))
    assert config["grid_size"] == len(grid["grid"]) == 28 and config["augment"] == 2 and config["model"] in (f"{files}/m", f"{files}/m2") and set(grid["learned_only"]) == {f"{files}/m", f"{files}/m2"}
    assert grid["selected"] == config and grid["baseline"]["strict_ceiling"] >= grid["baseline"]["strict_hr"]
    out = run(spark, files, capsys, f"rerank-learned --mode apply {ONE} --train-csv @train.csv --config @config --label x --lam 2.5 --rounds 50")
    said = json.loads(out.splitlines()[0])
    assert said["label"] == "x" and said["config"] == config | {"lambda": 2.5} and '"variant": "fused"' in out and '"user_lo"' in out
    with pytest.raises(SystemExit, match="pass --model"):
        run(spark, files, capsys, f"rerank-learned --mode apply {ONE} --train-csv @train.csv")
    with pytest.raises(SystemExit, match="unknown feature"):
        run(spark, files, capsys, f"rerank-learned --mode fit --model @m3 {COMMON} --train-csv @train.csv --features odd")


def test_rewrites(spark, files, capsys, tmp_path):
    run(spark, files, capsys, f"make-subsets --src-root {files} --out-dir {tmp_path}/s --train 10 --valid 5 --test 99")
    assert cli.readers.split_csv(spark, f"{tmp_path}/s/train").count() == 10 and cli.readers.split_csv(spark, f"{tmp_path}/s/test").count() == 20
    run(spark, files, capsys, f"remap-sids --src-root {files} --index @index_b.json --item-meta @meta.json --out-dir {tmp_path}/r")
    old, new = cli.rows_of(spark, f"{files}/test.csv"), cli.rows_of(spark, f"{tmp_path}/r/test")
    assert [tuple(r)[1:] for r in old.orderBy("row_id").collect()] == [tuple(r)[1:] for r in new.orderBy("row_id").collect()]
    assert cli.readers.info_file(spark, f"{tmp_path}/r/info").count() == 30
    run(spark, files, capsys, f"remap-sids --src-root {files} --index @index_a.json --item-meta @meta.json --out-dir {tmp_path}/f --one-file 1")
    for split in ("train", "valid", "test"):  # the same index gives the same file but for the line ends
        assert (tmp_path / "f" / f"{split}.csv").read_bytes() == (files / f"{split}.csv").read_bytes().replace(b"\r\n", b"\n")
    assert (tmp_path / "f" / "info.txt").read_text().splitlines()[7] == "<a_1><b_7><c_0>\tthing number 7\t7"
    run(spark, files, capsys, f"prepare --source @test.csv --output {tmp_path}/e")
    part = next((tmp_path / "e").glob("part*.json"))
    assert '"losses"' in run(spark, files, capsys, f"train --examples {part} --epochs 1 --dim 8")
