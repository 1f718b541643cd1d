"""Text files read in ranges by many tasks, with the numbers that their lines and records have in the file.

Spark deals a file out in ranges of bytes that end at line breaks. What a range needs
to know of those before it is small: how many lines they hold, and for CSV
whether a quoted cell is open where it starts and how many records have begun. A first
pass tells these of each range, for CSV under both assumptions, and composing
them in order picks the right one.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import written


def text_ranges(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """(file, start, value): lines without their line feed, or what lies between other separators, in the order of the file within a range."""
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines from 0 on, through all files in the order of their names; a carriage return at the end stays."""
    lines = written(text_ranges(spark, path).withColumn("at", F.monotonically_increasing_id()), "lines")
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return lines.join(F.broadcast(counts), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines of one range at a time, some at a time."""
    for b in batches:
        file, start, value = (b.column(i).to_pylist() for i in range(3))
        lo = 0
        for i in range(1, len(value) + 1):
            if i == len(value) or (file[i], start[i]) != (file[lo], start[lo]):
                yield (file[lo], start[lo]), value[lo:i]
                lo = i


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, odd, begun_0, begun_1): whether a range's quotes are odd in number, and how many records begin in it if no cell is open at its start, and if one is."""
    seen: dict[tuple[str, int], list[int]] = {}
    for key, lines in by_range(batches):
        own = seen.setdefault(key, [0, 0, 0])
        for line in lines:
            own[1 + own[0]] += not _blank(line)  # a record begins where the quotes before are even
            own[0] ^= line.count('"') & 1
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(3))], names=["file", "start", "odd", "begun_0", "begun_1"])


def parsed(records: list[str]) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO("".join(f"{r}\n" for r in records), newline="")) if r]


def _cells(before: dict[tuple[str, int], tuple[int, int, int]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records have cells; parts of records that go over a border have a text. A file's first record is its header and goes."""

        def out(record: list, cells: list, start: int, text: list) -> pa.RecordBatch:
            if record and record[0] < least:
                record, cells, text = record[1:], cells[1:], text[1:]
            cells = [None if c is None else [x or None for x in c[:width]] + [None] * (width - len(c)) for c in cells]
            return pa.RecordBatch.from_arrays([pa.array(record, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array([start] * len(record), pa.int64()), pa.array(text, pa.string())], names=["record", "cells", "start", "text"])

        at, number, is_open, held, head, least = None, 0, 0, [], False, 0

        def border():
            """The open record of a range that ends, or the part that it holds of one."""
            return out([number - 1], [None], at[1], ["\n".join(held)]) if held else None

        for key, lines in by_range(batches):
            if key != at:
                if at is not None and (last := border()):
                    yield last
                at, held = key, []
                is_open, number, least = before[key]
                head = bool(is_open)
            whole: list[str] = []
            first = number
            for line in lines:
                if not held and not is_open and _blank(line):
                    continue
                if not is_open and not held:
                    number += 1
                held.append(line)
                is_open ^= line.count('"') & 1
                if not is_open:
                    if head:
                        yield out([number - 1], [None], at[1], ["\n".join(held)])
                        head = False
                    else:
                        whole.append("\n".join(held))
                    held = []
            if whole:
                rows = parsed(whole)
                yield out(list(range(first, first + len(rows))), rows, at[1], [None] * len(rows))
        if at is not None and (last := border()):
            yield last

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, or a folder of such files: its columns as text, and row_id by place in the file, through all files in the order of their names. Quoted cells may hold line breaks; blank lines don't count, empty and missing cells are null, cells beyond the header go. Several tasks read a large file."""
    ranges = text_ranges(spark, path)
    found = sorted((tuple(r) for r in ranges.mapInArrow(_scan, "file string, start long, odd long, begun_0 long, begun_1 long").collect()), key=lambda r: r[:2])  # one for each range
    # Rows are numbered from 0; a header has the number before its file's first row.
    before, is_open, number, file, least = {}, 0, 0, None, 0
    for name, start, odd, *begun in found:
        if name != file:
            least = max(number, least)  # a file without a record has no header either
            is_open, file, number = 0, name, least - 1
        before[name, start] = (is_open, number, least)
        number += begun[is_open]
        is_open ^= odd
    top, header = [], []
    first = found[0][0] if found else None
    for (line,) in ranges.where((F.col("file") == first) & (F.col("start") == 0)).select("value").limit(1000).toLocalIterator():
        top.append(line)
        if not _blank(line) and sum(x.count('"') for x in top) % 2 == 0:
            header = parsed(["\n".join(top)])[0]
            break
    if header:
        header[0] = header[0].removeprefix("\ufeff")
    sent = spark.sparkContext.broadcast(before)
    width = len(header)
    schema = "record long, cells array<string>, start long, text string"
    rows = ranges.mapInArrow(lambda b: _cells(sent.value, width)(b), schema)
    rows = written(rows, "records")
    # Records over a border: their parts in order, and then their cells.
    parts = rows.where("text IS NOT NULL").groupBy("record").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "text")))["text"], "\n").alias("text"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [parsed([t])[0] for t in b.column(1).to_pylist()]
            cells = [[x or None for x in c[:width]] + [None] * (width - len(c)) for c in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.list_(pa.string()))], names=["record", "cells"])

    every = rows.where("text IS NULL").select("record", "cells").union(parts.mapInArrow(joined, "record long, cells array<string>"))
    return every.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(header)], F.col("record").alias("row_id"))
