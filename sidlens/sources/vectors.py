"""Matrices of .npy files read in ranges by many tasks.

Spark deals the bytes out in ranges that end at line feed bytes, which matrices of floats
seldom lack. Their lengths, summed over the ranges before, tell which rows of the
matrix a range holds; rows over a border are put together from their parts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import written
from .lines import by_range, text_ranges

LONGEST_HEAD = 1 << 14


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, n, head): how many bytes a range holds, and the first of a file."""
    seen: dict[tuple[str, int], list] = {}
    for key, pieces in by_range(batches):
        own = seen.setdefault(key, [0, b""])
        for x in pieces:
            own[0] += len(x) + 1
            if key[1] == 0 and len(own[1]) < LONGEST_HEAD:
                own[1] = (own[1] + x + b"\n")[:LONGEST_HEAD]
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.binary())], names=["file", "start", "n", "head"])


def _shape(head: bytes) -> tuple[int, int, int, str]:
    """(bytes of the header, rows, columns, type) of a file."""
    f = io.BytesIO(head)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    shape, fortran, dtype = read[np.lib.format.read_magic(f)](f)
    if len(shape) != 2 or not shape[1] or fortran or dtype.str not in ("<f2", "<f4"):
        raise ValueError(f"expected a 2-D array of <f2 or <f4 by rows, found {len(shape)}-D {dtype.str}")
    return f.tell(), *shape, dtype.str


def _rows(offsets: dict[tuple[str, int], int], files: dict[str, tuple[int, int, int, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, vec, at, part): whole rows, or the bytes of a part of one from byte `at` on."""

        def out(item: list, vec: list, at: list, part: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(vec, pa.list_(pa.float32())), pa.array(at, pa.int64()), pa.array(part, pa.binary())], names=["item", "vec", "at", "part"])

        def cut(n: int) -> bytes:
            nonlocal data, place
            taken, data, place = data[:n], data[n:], place + n
            return taken

        key_, data, place, first, width = None, b"", 0, 0, 1
        for key, pieces in by_range(batches):
            if key != key_:
                if data:
                    yield out([first + place // width], [None], [0], [data])
                key_, data = key, b""
                head, n, columns, kind, first = files[key[0]]
                width = columns * np.dtype(kind).itemsize
                place = offsets[key] - head  # in the matrix
            data += b"\n".join(pieces) + b"\n"
            if place < 0:
                cut(min(-place, len(data)))
            data = data[: max(n * width - place, 0)]
            if (at := place % width) and data:
                item = first + place // width
                yield out([item], [None], [at], [cut(min(width - at, len(data)))])
            if (k := len(data) // width) and place >= 0:
                item = first + place // width
                vec = np.frombuffer(cut(k * width), kind).reshape(k, columns).astype(np.float32)
                yield out(list(range(item, item + k)), list(vec), [None] * k, [None] * k)
        if data:
            yield out([first + place // width], [None], [0], [data])

    return run


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(item, vec) of a 2-D .npy file of half or single floats by rows, numbered from 0, through all files of a folder in the order of their names. Other arrays and files cut short are errors. Many tasks read a large file."""
    raw = text_ranges(spark, path).withColumn("value", F.col("value").cast("binary"))
    found = sorted((tuple(r) for r in raw.mapInArrow(_lengths, "file string, start long, n long, head binary").collect()), key=lambda r: r[:2])  # one for each range
    offsets, files, sizes, items = {}, {}, {}, 0
    for file, start, n, head in found:
        if file not in files:
            files[file] = (*_shape(bytes(head)), items)
            items += files[file][1]
            sizes[file] = 0
        offsets[file, start] = sizes[file]
        sizes[file] += n
    for file, (head, n, columns, kind, _) in files.items():
        # A file that ends without a line feed counts one byte too many.
        if sizes[file] - head - n * columns * np.dtype(kind).itemsize not in (0, 1):
            raise ValueError(f"{file} doesn't hold {n} rows of {columns}")
    sent = spark.sparkContext.broadcast((offsets, files))
    kinds = {x[3] for x in files.values()}
    if len(kinds) > 1:
        raise ValueError(f"files differ in type: {sorted(kinds)}")
    kind = min(kinds, default="<f4")
    rows = written(raw.mapInArrow(lambda b: _rows(*sent.value)(b), "item long, vec array<float>, at long, part binary"), "vectors")
    parts = rows.where("part IS NOT NULL").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "part")))["part"].alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.frombuffer(b"".join(p), kind).astype(np.float32) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.list_(pa.float32()))], names=["item", "vec"])

    return rows.where("part IS NULL").select("item", "vec").union(parts.mapInArrow(joined, "item long, vec array<float>"))
