"""What the operators share: written tables, Arrow text access, vectorised word hashes."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


# ---------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Unset, it is one of our own if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints/sidlens-{os.getpid()}"
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that `saved` gave and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_sidlens_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    folder = tempfile.mkdtemp()
    (Path(folder) / "sidlens_package.zip").write_bytes(held.getvalue())
    sc.addPyFile(f"{folder}/sidlens_package.zip")  # copied to the driver's file server
    sc._sidlens_shipped = True


#: Bytes of a batch between Spark and a Python worker, at most; it bounds what a worker holds of long texts.
BATCH_BYTES = 4 << 20


_kept: dict[tuple, object] = {}
_used: set[tuple] = set()


def kept(make: Callable) -> Callable:
    """make(*key), once in a worker, until a task of another kind runs there."""

    @wraps(make)
    def one(*key):
        at = (make.__qualname__, *key)
        _used.add(at)
        if at not in _kept:
            _kept[at] = make(*key)
        return _kept[at]

    return one


def given_back() -> None:
    """What the task before this one didn't use, and what is free, goes back to the machine: a worker lives on for other tasks and stages."""
    for at in set(_kept) - _used:
        del _kept[at]
    _used.clear()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with the package at hand and batches of bounded size. Spark reads the bound when a plan runs, so it stays set on the session, unless the session has one of its own."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            given_back()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def whole(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """A name for a helper column that none of the columns has."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- Arrow


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(lengths_at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row that is longer."""
    n, lo = len(lengths_at) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(lengths_at, lengths_at[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def blocks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in runs(at, most):
            yield batch.slice(lo, hi - lo)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- hashes

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Chunks of 8 bytes up to which spans are hashed side by side; longer ones are hashed one by one.
SIDE_BY_SIDE = 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], chunk after chunk through `mix`, which isn't linear: no text makes others collide, as with polynomial hashes."""
    size = ends - starts
    out = mix((size.astype(_U) + _U(salt << 32)) * _MULT + _U(1))
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], starts[order]
    long = int(np.searchsorted(-size, -8 * SIDE_BY_SIDE, "left"))
    h = out[order]
    for i in range(long):
        digest = hashlib.blake2b(data[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8, salt=salt.to_bytes(2, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    size, begin, rest = size[long:], begin[long:], h[long:]
    for c in range(0, int(size[0]) if len(size) else 0, 8):
        n = int(np.searchsorted(-size, -c, "left"))  # spans with more than c bytes
        word = at[begin[:n] + c]
        short = int(np.searchsorted(-size[:n], -(c + 8), "right"))  # from here on the chunk isn't full
        word[short:] &= (_U(1) << (_U(8) * (size[short:n] - c).astype(_U))) - _U(1)
        rest[:n] = mix(rest[:n] ^ word)
    out[order[:long]] = h[:long]
    out[order[long:]] = rest
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where all words [^\\x20\\x09-\\x0D]+ start and end, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = word & (~before | edge[:n])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = word & (~after | edge[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, at: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each row's first word (one more entry than rows)."""
    starts, ends = word_places(data, at)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    return span_hashes(_LOWER[data] if fold_case else data, starts, ends), np.searchsorted(starts, at, "left")


def shingles(data: np.ndarray, at: np.ndarray, n: int, fold_case: bool = True) -> list[np.ndarray]:
    """Each row's distinct n-word shingle hashes, ascending. Fewer words: the whole sequence as one; no word: none."""
    words, first = word_hashes(data, at, fold_case)
    grams = np.zeros(max(0, len(words) - n + 1), _U)
    for j in range(n):
        grams += words[j : j + len(grams)] * (mix(np.array([j + 1], _U))[0] | _U(1))
    grams = mix(grams)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n:
            g = np.sort(grams[lo : hi - n + 1])
            if len(g) > 1:
                g = g[np.concatenate(([True], g[1:] != g[:-1]))]
            out.append(g)
        elif hi > lo:
            h = np.array([hi - lo], _U)
            for w in words[lo:hi]:
                h = mix(h * _MULT + w)
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


# ---------------------------------------------------------------- graphs


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; root is the component's least node.

    Alternates large-star and small-star steps until the edges are stars. Each
    step sends a node's neighbours to its least one, so no group is gathered,
    and it takes about log(n) rounds whatever the shape.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e, before = saved(e, "edges"), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u") % 1_000_000_007).alias("s")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        last, e = e, saved(small.union(lowest.select("v", F.col("m").alias("u"))).distinct(), "edges")
        dropped(last)
    roots = e.select(F.col("u").alias("node")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select("node", F.col("node").alias("root")))
