"""JSON files read in ranges by many tasks: the objects of a list, or the members of one object.

Spark deals a file out in ranges of bytes that end at commas, whatever its line breaks. Of
the ranges before it, a range needs to know whether a string is open where it starts and
how deep it starts. A first pass tells of each range how it changes both, under either
assumption about the string, and composing them in order picks the right one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import written
from .lines import by_range, text_ranges

ESCAPED = re.compile(r"\\.", re.DOTALL)
AROUND = " \t\r\n[]﻿"


class _State:
    """Whether a string is open, and how many brackets are: braces only, or (members) all."""

    def __init__(self, in_string: int, depth: int, members: bool):
        self.in_string, self.depth, self.members = in_string, depth, members

    def over(self, piece: str) -> bool:
        """Goes over a piece; whether it holds an opening brace outside strings."""
        if "\\" in piece:
            piece = ESCAPED.sub("", piece)
        parts = piece.split('"')
        outside = "".join(parts[self.in_string :: 2])
        self.in_string ^= (len(parts) - 1) & 1
        self.depth += outside.count("{") - outside.count("}")
        if self.members:
            self.depth += outside.count("[") - outside.count("]")
        return "{" in outside

    @property
    def between(self) -> bool:
        return not self.in_string and self.depth <= self.members


def _scan(members: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, start, odd, deeper_0, deeper_1): whether a range's quotes are odd in number, and by how much depth grows in it if no string is open at its start, and if one is."""
        seen: dict[tuple[str, int], tuple[_State, _State]] = {}
        for key, pieces in by_range(batches):
            states = seen.setdefault(key, (_State(0, 0, members), _State(1, 0, members)))
            for piece in pieces:
                for s in states:
                    s.over(piece)
        keys = list(seen)
        columns = [[seen[k][0].in_string for k in keys], [seen[k][0].depth for k in keys], [seen[k][1].depth for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["file", "start", "odd", "deeper_0", "deeper_1"])

    return run


def _split(before: dict[tuple[str, int], tuple[int, int]], members: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, start, n, whole, text): the n-th entry that begins in a range, from 0 on, or a part of one that goes over a border; -1 is that which was open before."""

        def out(rows: list[tuple[int, bool, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key_[0]] * len(rows), pa.string()), pa.array([key_[1]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string())], names=["file", "start", "n", "whole", "text"])

        key_, state, n, held, head = None, None, -1, [], False
        for key, pieces in by_range(batches):
            if key != key_:
                if held:
                    yield out([(n, False, ",".join(held))])
                key_, n, held = key, -1, []
                state = _State(*before[key], members)
                head = not state.between
            rows: list[tuple[int, bool, str]] = []
            for piece in pieces:
                begins, top = state.between and not held, state.depth == 0
                opens = state.over(piece)
                if begins and not (members or opens):
                    continue  # brackets around objects
                if begins:
                    n += 1
                    piece = piece if top or not members else "{" + piece
                held.append(piece)
                if state.between:
                    if members and state.depth:
                        held[-1] += "}"
                    rows.append((n, not head, ",".join(held)))
                    held, head = [], False
            if rows:
                yield out(rows)
        if held:
            yield out([(n, False, ",".join(held))])

    return run


def json_entries(spark: SparkSession, path: str, members: bool = False) -> DataFrame:
    """(entry, text): the outermost objects of a JSON file of lists, however nested, numbered from 0 by place; or (members) each member of the object that the file holds, as an object of its own, and an empty object where it has none. A folder's files follow each other in the order of their names. Empty files have no entries; a file that ends within one is an error. Several tasks read a large file, even one without line breaks."""
    ranges = text_ranges(spark, path, ",")
    found = sorted((tuple(r) for r in ranges.mapInArrow(_scan(members), "file string, start long, odd long, deeper_0 long, deeper_1 long").collect()), key=lambda r: r[:2])  # one for each range
    before, file, in_string, depth = {}, None, 0, 0
    for name, start, odd, *deeper in [*found, (None, 0, 0, 0, 0)]:
        if name != file:
            if in_string or depth:
                raise ValueError(f"{file} ends within an entry")
            file = name
        before[name, start] = (in_string, depth)
        depth += deeper[in_string]
        in_string ^= odd
    sent = spark.sparkContext.broadcast(before)
    rows = written(ranges.mapInArrow(lambda b: _split(sent.value, members)(b), "file string, start long, n long, whole boolean, text string"), "entries")
    counts = rows.groupBy("file", "start").agg((F.max("n") + 1).alias("begun"))  # a row for each range
    w = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "start", F.coalesce(F.sum("begun").over(w), F.lit(0)).alias("first"))
    numbered = rows.join(F.broadcast(counts), ["file", "start"]).withColumn("entry", F.col("first") + F.col("n"))
    # Entries over a border: their parts in order. Other entries aren't shuffled.
    parts = numbered.where("NOT whole").groupBy("entry").agg(F.array_join(F.array_sort(F.collect_list(F.struct("file", "start", "text")))["text"], ",").alias("text"))
    every = numbered.where("whole").select("entry", "text").union(parts)
    return every if members else every.withColumn("text", F.btrim("text", F.lit(AROUND)))
