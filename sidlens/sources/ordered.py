"""One text file in order, written by many tasks, each line to its own place.

Running sums of the lines' lengths tell where each begins. Nothing goes through the
driver; a task that runs twice writes the same bytes to the same place. The folder has
to be a mount that the driver and all executors share; object stores take folders of
part files instead.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import with_running


def csv_line(df: DataFrame, columns: list[str]) -> Column:
    """The cells as one CSV record, quoted only where they must be; null is empty."""

    def cell(c: str) -> Column:
        x = F.coalesce(df[c].cast("string"), F.lit(""))
        return F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    if len(columns) == 1:  # an empty cell alone would be a blank line
        return F.when(cell(columns[0]) == "", F.lit('""')).otherwise(cell(columns[0]))
    return F.concat_ws(",", *map(cell, columns))


def one_file(lines: DataFrame, path: str, head: str | None = None, end: str = "\n") -> int:
    """Writes (order, line) to one file in order, after a first line if one is given, each with its end; returns how many bytes. The file takes its name once it is whole; one that was there is replaced. Orders have to differ; a null line is empty."""
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"{path} isn't on a mounted folder; write a folder of part files")
    first = b"" if head is None else (head + end).encode()
    line = F.concat(F.coalesce("line", F.lit("")), F.lit(end))
    placed = with_running(lines.select("order", line.alias("line")), F.octet_length("line").cast("long"), "order", name="till")
    placed = placed.select((F.col("till") - F.octet_length("line")).alias("at"), "line")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "xb") as f:
        f.write(first)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(part, "r+b") as f:  # not made anew: where the folder isn't shared this fails
            for b in batches:
                for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if f.tell() != len(first) + at:
                        f.seek(len(first) + at)
                    n += f.write(text.encode())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    total = len(first) + (placed.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0)
    if os.path.getsize(part) != total:
        raise OSError(f"{part} holds {os.path.getsize(part)} bytes of {total}: do all executors write to the driver's folder?")
    os.replace(part, path)
    return total
