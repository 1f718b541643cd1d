"""The best SIDs of a catalog by sums of level scores, found best first in a trie.

A node's bound is what its own codes score and the most that the row scores on
each level below. The node of the greatest bound is opened next; the search ends
once no bound reaches the k-th best SID found. A row opens few nodes, whatever
the catalog holds. A catalog comes in shards of bounded size, one after the other,
each search starting from the best that the row has so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sid as S
from ..plans.session import with_index, written

#: SIDs of a shard, which every task holds.
SHARD = 1 << 20


class Trie:
    """SIDs in order of their codes: nodes of a level are runs of equal codes."""

    def __init__(self, sids: pa.Array, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        self.sids = sids
        self.codes = [np.unique(x) for x in (a, b, c)]
        a, b, self.c = (np.searchsorted(u, x) for u, x in zip(self.codes, (a, b, c), strict=True))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        self.leaves = np.append(np.flatnonzero(new), len(a))  # where each (a, b) starts
        self.b, top = b[new], a[new]
        self.inner = np.append(np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(top) else 0, len(top))  # where each a starts
        self.a = top[self.inner[:-1]] if len(top) else top

    def scores_of(self, level: int, codes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A row's scores by place among the level's codes; what it doesn't score is least of all."""
        out = np.full(len(self.codes[level]), -np.inf)
        at = np.searchsorted(self.codes[level], codes)
        at[at == len(out)] = 0
        fits = self.codes[level][at] == codes if len(out) else np.zeros(len(codes), bool)
        out[at[fits]] = values[fits]
        return out

    def best(self, scores: list[np.ndarray], k: int, held: list[tuple[float, str]]) -> tuple[list[tuple[float, str]], int]:
        """The k best (-score, SID), ties to the first SID, of these and those held already; and how many nodes were opened. Sums go from the first level on, so a bound is never below what it bounds."""
        va, vb, vc = scores
        if not len(self.a):
            return held, 0
        most_b, most_c = vb.max(), vc.max()
        best, opened = sorted(held)[:k], 0
        tops = (va[self.a] + most_b) + most_c
        heap = [(-t, 0, i) for i, t in enumerate(tops.tolist()) if t > -np.inf]
        heapq.heapify(heap)
        while heap:
            bound, level, i = heapq.heappop(heap)
            if len(best) == k and bound > best[-1][0]:
                break
            opened += 1
            if level == 0:
                lo, hi = self.inner[i], self.inner[i + 1]
                bounds = (va[self.a[i]] + vb[self.b[lo:hi]]) + most_c
                fits = np.flatnonzero(bounds >= (-best[-1][0] if len(best) == k else -np.finfo(float).max))
                for j in fits.tolist():
                    heapq.heappush(heap, (-float(bounds[j]), 1, (i, int(lo) + j)))
            else:
                top, j = i
                lo, hi = self.leaves[j], self.leaves[j + 1]
                found = (va[self.a[top]] + vb[self.b[j]]) + vc[self.c[lo:hi]]
                fits = np.flatnonzero(found >= (-best[-1][0] if len(best) == k else -np.finfo(float).max))
                best = sorted(best + [(-float(found[x]), self.sids[int(lo) + x].as_py()) for x in fits.tolist()])[:k]
        return best, opened


def best_sids(scores: DataFrame, catalog: DataFrame, levels: tuple = ("a", "b", "c"), k: int = 1) -> DataFrame:
    """(row_id, sid, score), for more than one with `place` from 1: each row's k catalog SIDs of the greatest sums of level scores (row_id, level, code, v); of equal ones the first in order. SIDs with a code that the row doesn't score don't count; an empty catalog gives nothing."""
    spark = scores.sparkSession
    c = catalog.select("sid").distinct().select("sid", *[S.code(F.col("sid"), x).cast("long").alias(x) for x in "abc"]).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    c = written(with_index(c, "a", "b", "c", "sid"), "trie")
    n = c.count()
    # A row's scores, as many as the codebooks have codes.
    own = [F.collect_list(F.when(F.col("level") == x, F.struct(F.col("code").cast("long").alias("code"), F.col("v").cast("double").alias("v")))).alias(f"s{i}") for i, x in enumerate(levels)]
    rows = scores.where("code IS NOT NULL AND v IS NOT NULL").groupBy("row_id").agg(*own)
    kind = rows.schema["row_id"].dataType.simpleString()
    rows = rows.select("row_id", *[F.col(f"s{i}.{f}").alias(f"{f}{i}") for i in range(3) for f in ("code", "v")], F.array().cast("array<double>").alias("score"), F.array().cast("array<string>").alias("sid"))
    schema = rows.schema

    def searched(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(*sent.value)
            for b in batches:
                lists = [[x.values.to_numpy(zero_copy_only=False) for x in b.column(i)] for i in range(1, 7)]
                new = []
                for r, (less, sids) in enumerate(zip(b.column(7).to_pylist(), b.column(8).to_pylist(), strict=True)):
                    own = [trie.scores_of(i, lists[2 * i][r], lists[2 * i + 1][r]) for i in range(3)]
                    new.append(trie.best(own, k, list(zip(less, sids, strict=True)))[0])
                found = [pa.array([[x[j] for x in row] for row in new], b.schema.field(7 + j).type) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:7], *found], names=b.schema.names)

        return run

    for lo in range(0, n, SHARD):
        t = c.where(F.col("idx").between(lo, lo + SHARD - 1)).select("sid", "a", "b", "c", "idx").toArrow().sort_by("idx").combine_chunks()
        part = (t.column("sid").combine_chunks(), *(t.column(x).to_numpy() for x in "abc"))
        rows = rows.mapInArrow(searched(spark.sparkContext.broadcast(part)), schema)
    out = rows.select("row_id", F.posexplode(F.arrays_zip("score", "sid")).alias("place", "x")).select(F.col("row_id").cast(kind), "x.sid", (-F.col("x.score")).alias("score"), (F.col("place") + 1).alias("place"))
    return out if k > 1 else out.drop("place")
