import csv
import json
import random

import numpy as np
import pytest

from sidlens.sources import entries, lines, ordered, readers, writers
from sidlens.streaming import metric_log


def put(path, text):
    path.write_text(text)
    return str(path)


def test_results(spark, tmp_path):
    flat = [{"predict": [' "x" ', "y"], "output": "y"}, {"predict": [], "output": ["z"]}]
    want = [(0, ["x", "y"], "y"), (1, [], "z")]
    assert [tuple(r) for r in readers.results(spark, put(tmp_path / "a.json", json.dumps(flat))).collect()] == want
    assert [tuple(r) for r in readers.results(spark, put(tmp_path / "b.json", json.dumps([flat[:1], flat[1:]]))).collect()] == want


def test_catalog(spark, tmp_path):
    index = put(tmp_path / "i.json", json.dumps({"7": ["<a_1>", "<b_2>", "<c_3>"]}))
    meta = put(tmp_path / "m.json", json.dumps({"7": {"title": "Mug"}}))
    assert [tuple(r) for r in readers.catalog(spark, index, meta).collect()] == [(7, "<a_1><b_2><c_3>", "Mug")]
    none = put(tmp_path / "n.json", "{}")
    with pytest.raises(Exception, match="no metadata"):
        readers.catalog(spark, index, none).collect()


def test_split_round_trip(spark, tmp_path):
    path = put(tmp_path / "test.csv", 'user_id,item_id,item_sid,history_item_id,history_item_sid,note\nu,7,x/y/z,"[1, 2]","[\'a/b/c\', \'d/e/f\']","say ""hi""\nthere, ok"\n')
    r = readers.interactions(spark, path).first()
    assert (r["row_id"], r["user_id"], r["item_id"], r["history_ids"], r["history_sids"]) == (0, "u", 7, [1, 2], ["a/b/c", "d/e/f"])
    writers.split_csv(readers.split_csv(spark, path), str(tmp_path / "out"))
    again = readers.split_csv(spark, str(tmp_path / "out")).drop("row_id").collect()
    assert again == readers.split_csv(spark, path).drop("row_id").collect()
    good, bad = readers.sid_csv(spark, path)
    assert good.first()["history"] == ["a/b/c", "d/e/f"] and bad.count() == 0
    assert readers.split_file(spark, str(tmp_path), "test").endswith("test.csv")
    with pytest.raises(FileNotFoundError):
        readers.split_file(spark, str(tmp_path), "valid")


def test_examples(spark, tmp_path):
    good, bad = readers.examples_jsonl(spark, put(tmp_path / "e.jsonl", '{"history": ["x/y/z"], "target": "x/y/z"}\n\n{"history": [], "target": "x/y/z"}\nnope\n'))
    assert [r["row_id"] for r in good.collect()] == [1]
    assert {r["line"]: r["error"] for r in bad.collect()} == {3: "empty history", 4: "not an example"}


def test_info_vectors_model(spark, tmp_path):
    assert [tuple(r) for r in readers.info_file(spark, put(tmp_path / "info.txt", 'x\tA "q"\t1\n\ny\n')).collect()] == [("x", 'A "q"', "1"), ("y", None, None)]
    np.save(tmp_path / "v.npy", np.array([[1, 2], [3, 4]], np.float16))
    assert [tuple(r) for r in readers.npy_vectors(spark, str(tmp_path / "v.npy")).collect()] == [(0, [1, 2]), (1, [3, 4])]
    writers.model(spark, {"features": ["x", "y"], "weights": [1, 2]}, str(tmp_path / "model"))
    assert readers.reranker(spark, str(tmp_path / "model"))["index"] == [0, 1]
    writers.model(spark, {"features": ["x", "y"], "weights": [1]}, str(tmp_path / "model"))
    with pytest.raises(ValueError, match="differ"):
        readers.reranker(spark, str(tmp_path / "model"))


def test_metric_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    put(tmp_path / "log" / "r1.jsonl", '{"step": 1, "hr@10": 0.1}\n{"step": 2, "hr@10": 0.3}\nbroken\n{"step": 3, "error": "x"}\n{"step": 4, "hr@10": 0.3}\n')
    assert readers.metric_log(spark, str(tmp_path / "log")).count() == 3
    for _ in range(2):
        metric_log.start(metric_log.read(spark, str(tmp_path / "log")), str(tmp_path / "curve"), str(tmp_path / "cp")).awaitTermination(60)
        put(tmp_path / "log" / "r2.jsonl", '{"step": 9, "hr@10": 0.5}\n')
    got = {r["log"]: (r["points"], r["start"], r["best"], r["best_step"], r["final"]) for r in spark.read.parquet(str(tmp_path / "curve")).collect()}
    assert got == {"r1.jsonl": (3, 0.1, 0.3, 2, 0.3), "r2.jsonl": (1, 0.5, 0.5, 9, 0.5)}


@pytest.mark.parametrize(("end", "size"), [("\n", 7000), ("\r\n", 3001), ("\r\n", 1 << 27)])
def test_csv_in_ranges_is_what_one_reader_sees(spark, tmp_path, end, size):
    rng = random.Random(size)
    cell = lambda: "".join(rng.choices(["a", "b", ",", '"', "\n", "\r\n", "é", " "], k=rng.randrange(30)))
    paths = [tmp_path / "some" / f"{i}.csv" for i in range(3)]
    paths[0].parent.mkdir()
    paths[1].write_text("")
    for path in (paths[0], paths[2]):
        with open(path, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["a", "b\nc", "d"])
            for i in range(120):
                w.writerow([cell(), i, cell() if i % 3 else "x" * rng.randrange(400) + "\n\n" + "y" * rng.randrange(400)])
                f.write(end * (i % 50 == 7))
            w.writerow(["short"])
            w.writerow(["1", "2", "3", "beyond"])
    read = lambda p: [tuple(x or None for x in (r + [""] * 3)[:3]) for r in csv.reader(open(p, newline="", encoding="utf-8")) if r][1:]  # noqa: E731, SIM115
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert size > 10_000 or spark.read.text(str(paths[0])).rdd.getNumPartitions() > 3
        for path, want in ((paths[0], read(paths[0])), (paths[0].parent, read(paths[0]) + read(paths[2]))):
            df = lines.csv_records(spark, str(path))
            got = sorted(df.collect(), key=lambda r: r["row_id"])
            assert df.columns == ["a", "b\nc", "d", "row_id"]
            assert [tuple(r)[:3] for r in got] == want and [r["row_id"] for r in got] == list(range(len(want)))
        text = open(paths[0], newline="", encoding="utf-8").read().removesuffix("\n").split("\n")  # noqa: SIM115
        assert sorted(map(tuple, lines.numbered_lines(spark, str(paths[0])).collect())) == list(enumerate(text))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def in_ranges(spark, size):
    for k, v in (("spark.sql.files.maxPartitionBytes", str(size)), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)


@pytest.fixture
def ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("indent", "size"), [(None, 3001), (1, 5003), (2, 1 << 27)])
def test_json_in_ranges_is_what_one_reader_sees(spark, tmp_path, ranges, indent, size):
    rng = random.Random(size)
    text = lambda: "".join(rng.choices(["a", "b", ",", '"', "\n", "\\", "{", "}", "[", "]", "é", " "], k=rng.randrange(12)))
    flat = [{"predict": [text() for _ in range(rng.randrange(4))], "output": "x,{" * rng.randrange(9, 400 if i % 9 else 5000)} for i in range(40)]
    flat[7]["more"] = {"deep": [{"predict": [text()]}, [[]]]}
    cut = [[], flat[:5], [], [], flat[5:31], flat[31:], []]
    objects = {str(i): {"title": text(), "more": {"k,": [text(), {}]}} for i in range(40)}
    for name, x in (("flat", flat), ("nested", cut), ("none", []), ("meta", objects), ("empty", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=indent, ensure_ascii=indent == 1) + "\n" * (indent == 1), encoding="utf-8")
    (tmp_path / "some").mkdir()
    (tmp_path / "some" / "b.json").write_text(json.dumps(flat[20:]))
    (tmp_path / "some" / "a.json").write_text(json.dumps(flat[:20]))
    (tmp_path / "some" / "c.json").write_text("")
    in_ranges(spark, size)
    assert size > 10_000 or spark.read.option("lineSep", ",").text(str(tmp_path / "flat.json")).rdd.getNumPartitions() > 3
    for name, want in (("flat.json", flat), ("nested.json", flat), ("none.json", []), ("some", flat)):
        got = sorted(map(tuple, entries.json_entries(spark, str(tmp_path / name)).collect()))
        assert [i for i, _ in got] == list(range(len(want)))
        assert [json.loads(t) for _, t in got] == want, name
    got = [json.loads(t) for _, t in entries.json_entries(spark, str(tmp_path / "meta.json"), members=True).collect()]
    assert sorted(k for x in got for k in x) == sorted(objects) and {k: v for x in got for k, v in x.items()} == objects
    titles = {r["item"]: r["title"] for r in readers.item_meta(spark, str(tmp_path / "meta.json")).collect()}
    assert titles == {int(k): v["title"] for k, v in objects.items()}
    assert readers.item_meta(spark, str(tmp_path / "empty.json")).count() == 0
    r = {r["row_id"]: r["output"] for r in readers.results(spark, str(tmp_path / "nested.json")).collect()}
    assert r == dict(enumerate(x["output"] for x in flat))


def test_json_that_ends_early_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="ends within"):
        readers.results(spark, put(tmp_path / "x.json", '[{"predict": ["a", "b"'))
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        readers.results(spark, put(tmp_path / "y.json", '[{"predict": 7 8, "output": "a"}]')).collect()


def test_a_split_comes_back_byte_for_byte(spark, tmp_path):
    rng = random.Random(1)
    cell = lambda: "".join(rng.choices(["a", " ", ",", '"', "\n", "\r\n", "é", "\t", "\\", "'"], k=rng.randrange(9)))
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["item_id", "a,b", "note "])
        for i in range(500):
            w.writerow([i, cell(), cell()])
    rows = readers.split_csv(spark, str(path)).repartition(7)
    (tmp_path / "out.csv").write_text("what was there before")
    for _ in range(2):
        writers.split_csv(rows, str(tmp_path / "out.csv"))
        assert (tmp_path / "out.csv").read_bytes() == path.read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "out.csv"]
    writers.split_csv(rows.where("row_id < 0"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_bytes() == path.read_bytes().split(b"\n")[0] + b"\n"
    # Part files keep white space around cells too.
    writers.split_csv(rows, str(tmp_path / "parts"))
    key = lambda df: sorted((tuple(r)[:3] for r in df.collect()), key=lambda r: int(r[0]))
    assert key(readers.split_csv(spark, str(tmp_path / "parts"))) == key(rows)


def test_lines_in_one_file(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "é")], "order long, line string")
    assert ordered.one_file(df, f"{tmp_path}/x/info.txt") == 6
    assert (tmp_path / "x" / "info.txt").read_text() == "\né\nc\n"
    writers.info_file(df.withColumnRenamed("order", "item"), f"file://{tmp_path}/y.tsv")
    assert (tmp_path / "y.tsv").read_text() == "\né\nc\n"
    with pytest.raises(ValueError, match="mounted"):
        ordered.one_file(df, "s3a://x/y.txt")
    one = spark.createDataFrame([(0, ""), (1, 'a"b')], "row_id long, x string")
    writers.split_csv(one, f"{tmp_path}/one.csv")
    assert [r for r in csv.reader(open(tmp_path / "one.csv", newline=""))] == [["x"], [""], ['a"b']]  # noqa: SIM115, C416


@pytest.mark.parametrize(("kind", "size"), [("<f2", 3001), ("<f4", 5003)])
def test_vectors_in_ranges(spark, tmp_path, ranges, kind, size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(300, 37)).astype(kind)
    a[5:40] = 0  # rows without a line feed byte
    a[77:80] = np.frombuffer(b"\n" * a.itemsize, kind)[0]
    a[-1, -1] = a[77, 0]  # the file ends with one
    (tmp_path / "some").mkdir()
    np.save(tmp_path / "some" / "a.npy", a)
    np.save(tmp_path / "some" / "b.npy", a[:0])
    np.save(tmp_path / "some" / "c.npy", a[:90])
    in_ranges(spark, size)
    assert spark.read.text(str(tmp_path / "some")).rdd.getNumPartitions() > 6
    for name, want in (("some/a.npy", a), ("some/b.npy", a[:0]), ("some", np.concatenate([a, a[:90]]))):
        got = sorted(map(tuple, readers.npy_vectors(spark, str(tmp_path / name)).collect()))
        assert [i for i, _ in got] == list(range(len(want)))
        assert np.array_equal(np.array([v for _, v in got], np.float32).reshape(want.shape), want.astype(np.float32))


def test_other_arrays_are_refused(spark, tmp_path):
    for name, x in (("int", np.zeros((2, 2), np.int32)), ("flat", np.zeros(4, np.float32)), ("columns", np.asfortranarray(np.ones((3, 2), np.float32)))):
        np.save(tmp_path / f"{name}.npy", x)
        with pytest.raises(ValueError, match="expected"):
            readers.npy_vectors(spark, str(tmp_path / f"{name}.npy"))
    np.save(tmp_path / "cut.npy", np.ones((9, 9), np.float32))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    with pytest.raises(ValueError, match="doesn't hold"):
        readers.npy_vectors(spark, str(tmp_path / "cut.npy"))
