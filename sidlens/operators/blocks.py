"""Lookups of item pairs in a large sparse table, without a join of pairs.

The table lies in blocks of consecutive pairs (a, b), a < b, as arrays. Each row's
candidates and history are paired inside its task, and the pairs travel in packets
to the block that may hold them, where they are looked up side by side; what comes
back are sums for each candidate. Blocks that many packets want are given to several
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import written

#: Pairs of a block; pairs made and sent at a time; packets of a block that one task looks up.
BLOCK, SOME, PACKETS = 1 << 16, 1 << 20, 64
_ARRAYS = ("a", "b", "c", "na", "nb", "ppmi")


def _binary(x: np.ndarray) -> bytes:
    """Integers as their least and differences from it in as few bytes as hold them; others as doubles."""
    if x.dtype.kind == "f":
        return x.astype("<f8").tobytes()
    least = int(x.min()) if len(x) else 0
    most = int(x.max()) - least if len(x) else 0
    width = max(1, (most.bit_length() + 7) // 8)
    above = x.astype("<u8") - np.uint64(least % (1 << 64))
    data = above.astype(f"<u{width}") if width in (1, 2, 4, 8) else above.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + least.to_bytes(8, "little", signed=True) + data.tobytes()


def _integers(data: pa.Buffer) -> np.ndarray:
    """What _binary made of integers."""
    head = bytes(data[:9])
    width = head[0]
    if width in (1, 2, 4, 8):
        above = np.frombuffer(data, f"<u{width}", offset=9).astype(np.int64)
    else:
        above = np.zeros(((len(data) - 9) // width, 8), np.uint8)
        above[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
        above = above.view("<i8").ravel()
    return above + int.from_bytes(head[1:], "little", signed=True)


@dataclass
class PairBlocks:
    """table: (first_a, first_b, arrays), a row for each block; firsts: each block's first pair as a key, in order, of which the driver holds one for each BLOCK pairs; base: see keys."""

    table: DataFrame
    places: list[tuple[int, int]]
    base: int

    def __post_init__(self):
        self.firsts = keys(*(np.array([p[i] for p in self.places], np.int64) for i in (0, 1)), self.base)


#: Ids below this make pairs that fit in 64 bits.
NARROW = 3_000_000_000


def keys(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Pairs as numbers that are ordered like them. Ids of the table are below base, or, where base is 0, below 2**53; others give the key of no pair."""
    if base:
        return np.where((a < base) & (b < base), a * base + b, -1)
    out = np.empty(len(a), np.complex128)
    out.real, out.imag = a, b
    return out


def pair_blocks(pairs: DataFrame) -> PairBlocks:
    """Blocks of the pairs (a, b, c, na, nb, ppmi), 0 <= a < b."""
    size = pairs.agg(F.count("*").alias("n"), (F.coalesce(F.max("b"), F.lit(0)) + 1).alias("base")).first()
    n, base = size["n"], size["base"] if size["base"] < NARROW else 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x = [part.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                row = [[int(x[0][0])], [int(x[1][0])], *([_binary(v)] for v in x)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(row)], names=["first_a", "first_b", *_ARRAYS])

    dealt = pairs.select(*[F.col(c).cast("double" if c == "ppmi" else "long") for c in _ARRAYS]).repartitionByRange(max(1, -(-n // BLOCK)), "a", "b").sortWithinPartitions("a", "b")
    table = written(dealt.mapInArrow(packed, "first_a long, first_b long, " + ", ".join(f"{c} binary" for c in _ARRAYS)), "blocks")
    return PairBlocks(table, sorted((r["first_a"], r["first_b"]) for r in table.select("first_a", "first_b").collect()), base)


def made_pairs(row: np.ndarray, history: list[np.ndarray], cands: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, candidate, other) of all pairs of different items of each row, about SOME at a time."""
    size = np.array([len(h) * len(c) for h, c in zip(history, cands, strict=True)], np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SOME, "right")))
        rows = np.repeat(row[lo:hi], size[lo:hi])
        left = np.concatenate([np.repeat(c, len(h)) for h, c in zip(history[lo:hi], cands[lo:hi], strict=True)])
        right = np.concatenate([np.tile(h, len(c)) for h, c in zip(history[lo:hi], cands[lo:hi], strict=True)])
        apart = left != right
        yield rows[apart], left[apart], right[apart]
        lo = hi


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def packets(firsts: np.ndarray, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            history = [np.unique(h) for h in _lists(batch.column(1))]
            for row, left, right in made_pairs(batch.column(0).to_numpy(), history, _lists(batch.column(2))):
                block = np.searchsorted(firsts, keys(np.minimum(left, right), np.maximum(left, right), base), "right") - 1
                # Few values sort fast.
                order = np.argsort(block.astype(np.int16) if len(firsts) < 1 << 15 else block, kind="stable")
                order = order[np.searchsorted(block[order], 0, "left") :]
                cuts = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist() + [len(order)]
                parts = [order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[p[0]]) for p in parts], pa.int32()), *(pa.array([_binary(x[p]) for p in parts], pa.binary()) for x in (row, left, right))], names=["block", "row", "item", "other"])

    return run


def found(base: int):
    """A mapper that gives sums over the pairs of packets that the block before them holds: rows come sorted by block, the block first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = key = None
        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() == 0:
                    held = [np.frombuffer(x, "<f8") if j == 6 else _integers(x) for j in range(1, 7) for x in (b.column(j)[i].as_buffer(),)]
                    key = keys(held[0], held[1], base)
                    continue
                row, item, other = (_integers(b.column(j)[i].as_buffer()) for j in (1, 2, 3))
                want = keys(np.minimum(item, other), np.maximum(item, other), base)
                at = np.searchsorted(key, want)
                at[at == len(key)] = 0
                hit = np.flatnonzero(key[at] == want)
                at, row, item, other = at[hit], row[hit], item[hit], other[hit]
                order = np.lexsort((item, row))
                at, row, item, other = at[order], row[order], item[order], other[order]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])))) if len(row) else np.zeros(0, np.int64)
                a, _, c, na, nb, ppmi = (x[at] for x in held)
                ppmi = np.maximum(ppmi, 0)
                share = c / np.maximum(np.where(item == a, nb, na), 1)
                sums = [np.add.reduceat(ppmi, first), np.maximum.reduceat(ppmi, first), np.add.reduceat(share, first), np.diff(np.append(first, len(row)))] if len(row) else [np.zeros(0)] * 3 + [np.zeros(0, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[first], item[first], *sums)], names=["row_id", "item", "ppmi_sum", "ppmi_max", "share_sum", "n"])

    return run


def matched(cand: DataFrame, rows: DataFrame, blocks: PairBlocks) -> DataFrame:
    """What matched_lists gives for candidates (row_id, item)."""
    return matched_lists(cand.groupBy("row_id").agg(F.collect_set("item").alias("items")), rows, blocks)  # a row's candidates


def matched_lists(own: DataFrame, rows: DataFrame, blocks: PairBlocks) -> DataFrame:
    """(row_id, item, ppmi_sum, ppmi_max, share_sum, n) of candidates (row_id, items), each once, that form a pair of the table with a different item of their row's history; share_sum adds up the pairs' counts by the history item's own, the others values above 0."""
    spark = own.sparkSession
    own = own.select("row_id", F.col("items").cast("array<long>").alias("items"))
    own = own.join(rows.select("row_id", F.col("hist").cast("array<long>").alias("hist")), "row_id").where(F.size("hist") > 0)
    own = written(own.select(F.col("row_id").cast("long"), F.filter("hist", lambda x: x.isNotNull()).alias("hist"), "items"), "asking")
    # Packets are many times their rows: they are made twice, once to be counted, and not written. Which task looks a packet up changes nothing.
    sent = own.mapInArrow(packets(blocks.firsts, blocks.base), "block int, row binary, item binary, other binary").withColumn("seq", F.monotonically_increasing_id())
    tasks = sent.select("block").groupBy("block").agg(F.ceil(F.count("*") / PACKETS).cast("int").alias("tasks"))  # a row for each block
    tasks = written(tasks, "tasks")
    places = spark.createDataFrame(pa.table({"block": pa.array(np.arange(len(blocks.places)), pa.int32()), "first_a": pa.array([p[0] for p in blocks.places], pa.int64()), "first_b": pa.array([p[1] for p in blocks.places], pa.int64())}))
    share = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("share")
    tables = blocks.table.join(F.broadcast(places), ["first_a", "first_b"]).join(tasks, "block").select("block", share, F.lit(0).alias("kind"), *_ARRAYS)
    none = F.lit(None).cast("binary")
    asked = sent.join(tasks, "block").select("block", F.pmod("seq", "tasks").cast("int").alias("share"), F.lit(1).alias("kind"), F.col("row").alias("a"), F.col("item").alias("b"), F.col("other").alias("c"), none.alias("na"), none.alias("nb"), none.alias("ppmi"))
    met = tables.union(asked).repartition("block", "share").sortWithinPartitions("block", "share", "kind").select("kind", *_ARRAYS)
    part = met.mapInArrow(found(blocks.base), "row_id long, item long, ppmi_sum double, ppmi_max double, share_sum double, n long")
    return part.groupBy("row_id", "item").agg(F.sum("ppmi_sum").alias("ppmi_sum"), F.max("ppmi_max").alias("ppmi_max"), F.sum("share_sum").alias("share_sum"), F.sum("n").alias("n"))
