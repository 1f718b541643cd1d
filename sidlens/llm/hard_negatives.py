"""Hard negatives by exact inner products that are taken bit-plane by bit-plane.

A component of a candidate is the sum of its bits' worths. Once the planes down to
a bit are added up, the lower ones can add to a product no less than the negative
and no more than the positive components of the anchor, times what these bits are
worth at most. Candidates whose interval rules them out are dropped before the
next plane.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import with_index
from .common import dropped, mapped, saved

SCALE = 256
#: Anchors of a round, which every task holds, and components of them; anchors compared at a time; candidates held at a time.
ROUND, ROUND_NUMBERS, SOME, CANDIDATES = 16384, 1 << 22, 256, 4096
#: Pairs are followed one by one once so few are left.
FEW = 0.15
#: Scores stay below, so that 100 of them fit in 64 bits.
MOST = 2**56
#: No score.
NONE = 2**62


def usable_rows(vectors: DataFrame, is_anchor: Column, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(row, id, label, v, anchor): rows that take part, components as floor(256 x); a number for each row. Components of 2**23 or more are an error."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**23, F.floor(x * SCALE).cast("int")).otherwise(F.raise_error(F.lit("components of 2**23 or more can't be scored in 64 bits")).cast("int")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("v"), "anchor")


def planes(x: np.ndarray) -> tuple[int, np.ndarray, int]:
    """The least component, what components have above it, and the bits of that."""
    low = int(x.min(initial=0))
    above = x.astype(np.int64) - low
    return low, above, int(above.max(initial=0)).bit_length()


def survivors(a: np.ndarray, x: np.ndarray, alive: np.ndarray, qualify: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, product) of the pairs in the mask `alive` that are left when all planes are added: qualify(anchors, lo, hi) tells of intervals which pairs may still count.

    It gets whole matrices (anchors: all, None) and later, when few pairs are left, lists of them.
    """
    low, above, bits = planes(x)
    a = a.astype(np.float64) if np.abs(a).max(initial=0) * max(int(np.abs(x).max(initial=0)), 1) * a.shape[1] * 2 < 2**52 else a.astype(np.int64)
    plus, minus = a.clip(min=0).sum(1), a.clip(max=0).sum(1)
    value = np.repeat((low * a.sum(1))[:, None], len(x), 1)
    b = bits - 1
    while b >= 0:
        value += (a * (1 << b)) @ (above >> b & 1).T.astype(a.dtype)
        left = (1 << b) - 1
        # Before intervals are narrower than the products lie apart, they rule out nothing.
        if value.size and left * float((plus - minus).max()) < 2 * float(value.max() - value.min()) + 1:
            alive &= qualify(None, value + left * minus[:, None], value + left * plus[:, None])
            if alive.sum() < FEW * alive.size:
                break
        b -= 1
    r, c = np.nonzero(alive)
    value = value[r, c]
    for b in range(b - 1, -1, -1):
        for i in range(0, len(r), 1 << 16):
            at = slice(i, i + (1 << 16))
            value[at] += np.einsum("pd,pd->p", a[r[at]] * (1 << b), (above[c[at]] >> b & 1).astype(a.dtype))
        left = (1 << b) - 1
        keep = qualify(r, value + left * minus[r], value + left * plus[r])
        r, c, value = r[keep], c[keep], value[keep]
    return r, c, value.astype(np.int64)


def best(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the k best of each group: by descending score, then id, then row; groups ascend."""
    order = np.lexsort((rows, ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - first < k]


class Held:
    """The best (group, score, id, row) seen so far, k of each group."""

    def __init__(self, k: int, groups: int):
        self.k, self.groups = k, groups
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(groups, -NONE, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(group):
            return
        merged = tuple(np.concatenate(x) for x in zip(self.best, (group, score, ids, rows), strict=True))
        at = best(self.k, *merged)
        self.best = tuple(x[at] for x in merged)
        g, score = self.best[:2]
        n = np.bincount(g, minlength=self.groups)
        full = n >= self.k
        ends = np.cumsum(n) - 1
        self.least[full] = score[ends[full]]


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, ids, labels, vectors) of up to CANDIDATES rows of one length."""
    held: dict[int, list] = {}
    for b in batches:
        rows, ids, labels = (b.column(i).to_numpy() for i in range(3))
        v = b.column(3)
        ends = v.offsets.to_numpy()
        flat = v.values.to_numpy()
        size = np.diff(ends)
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            x = flat[(ends[:-1][at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
            parts = held.setdefault(dim, [])
            parts.append((rows[at], ids[at], labels[at], x))
            if sum(len(p[0]) for p in parts) >= CANDIDATES:
                whole = tuple(np.concatenate(z) for z in zip(*held.pop(dim), strict=True))
                for lo in range(0, len(whole[0]), CANDIDATES):
                    yield tuple(z[lo : lo + CANDIDATES] for z in whole)
    for parts in held.values():
        yield tuple(np.concatenate(z) for z in zip(*parts, strict=True))


def checked(a: np.ndarray, x: np.ndarray) -> None:
    if a.size and x.size and int(np.abs(a).max()) * int(np.abs(x).max()) * a.shape[1] >= MOST:
        raise ValueError("a score may leave 56 bits")


class Anchors:
    """A round of anchors: their rows, ids and labels, and their vectors by length."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        v = table.column("v").combine_chunks()
        self.ends, self.flat = v.offsets.to_numpy(), v.values.to_numpy()
        self.dim = np.diff(self.ends)

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Those at places of one length."""
        dim = int(self.dim[at[0]])
        return self.flat[(self.ends[:-1][at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim).astype(np.int64)


def nearest_alike(anchors: Anchors, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, score, row): the k best other rows of each anchor's label among what the task reads; anchor is its place in the round."""
    held = Held(k, len(anchors.row))
    for rows, ids, labels, x in candidates(batches):
        mine = np.flatnonzero(anchors.dim == x.shape[1])
        for label in np.intersect1d(anchors.label[mine], labels).tolist():
            c = np.flatnonzero(labels == label)
            of_label = mine[anchors.label[mine] == label]
            for lo in range(0, len(of_label), SOME):
                own = of_label[lo : lo + SOME]
                a = anchors.vectors(own)
                checked(a, x[c])
                floor, alive = held.least[own].astype(np.float64), rows[c][None, :] != anchors.row[own][:, None]

                def qualify(r, low, high, floor=floor, alive=alive):
                    if r is not None:
                        return high >= floor[r]
                    if low.shape[1] >= k:
                        np.maximum(floor, np.partition(np.where(alive, low, -float(NONE)), -k, axis=1)[:, -k], out=floor)
                    return high >= floor[:, None]

                r, s, score = survivors(a, x[c], alive, qualify)
                held.add(own[r], score, ids[c[s]], rows[c[s]])
    g, score, ids, rows = held.best
    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids), pa.array(score), pa.array(rows)], names=["anchor", "id", "score", "row"])


def within_bands(anchors: Anchors, bands: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, id, score, row): for each band (low, high), of which an anchor has bands.shape[1], the k best rows of other labels in it among what the task reads; band counts through all anchors."""
    per = bands.shape[1]
    held = Held(k, len(anchors.row) * per)
    lows, highs = bands[:, :, 0].ravel(), bands[:, :, 1]
    for rows, ids, labels, x in candidates(batches):
        mine = np.flatnonzero(anchors.dim == x.shape[1])
        for lo in range(0, len(mine), SOME):
            own = mine[lo : lo + SOME]
            a = anchors.vectors(own)
            checked(a, x)
            # What no band of the anchor takes: below the least that any still takes, or above all.
            least = np.maximum(lows, held.least).reshape(-1, per)[own]
            floor, top = least.min(1), highs[own].max(1)

            def qualify(r, low, high, floor=floor, top=top):
                f, t = (floor[:, None], top[:, None]) if r is None else (floor[r], top[r])
                return (high >= f) & (low <= t)

            r, c, score = survivors(a, x, labels[None, :] != anchors.label[own][:, None], qualify)
            fits = (score[:, None] >= least[r]) & (score[:, None] <= highs[own[r]])
            pair, j = np.nonzero(fits)
            held.add(own[r[pair]] * per + j, score[pair], ids[c[pair]], rows[c[pair]])
    g, score, ids, rows = held.best
    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids), pa.array(score), pa.array(rows)], names=["band", "id", "score", "row"])


def first_of(found: DataFrame, group: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives` best other rows of the same label, the first `negatives` rows of another label whose score is low to high per cent of the positive's.

    Scores are inner products of floor(256 x). Higher ones come first, ties by the
    smaller id, then by row. Rows without an id, a label or a vector, or with an empty
    vector or a null or non-finite component, take no part; vectors meet those of their own length; a null
    condition is no anchor. Repeated rows count each, as others of one another.
    Components of 2**23 or more, and vectors whose scores may reach 2**56, are an error.

    Anchors come in rounds of bounded size, which every task holds; candidates stay
    where they are, and a task sends the best of all that it reads.
    """
    spark = vectors.sparkSession
    rows = saved(usable_rows(vectors, is_anchor, id_column, vector_column, label_column), "vectors")
    sizes = rows.agg(F.count_if("anchor").alias("n"), F.max(F.size("v")).alias("dim")).first()
    per_round = max(1, min(ROUND, ROUND_NUMBERS // max(sizes["dim"] or 1, 1)))
    numbered = saved(with_index(rows.where("anchor").drop("anchor"), "row"), "anchors")
    others = rows.select("row", "id", "label", "v")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for start in range(0, sizes["n"], per_round):
        anchors = Anchors(numbered.where(F.col("idx").between(start, start + per_round - 1)).select("row", "id", "label", "v").toArrow())
        sent = spark.sparkContext.broadcast(anchors)
        alike = mapped(others, lambda b, sent=sent: nearest_alike(sent.value, positives, b), "anchor long, id long, score long, row long")
        best_of = first_of(alike, "anchor", positives).select("anchor", "id", "score", "rank").toArrow()
        anchor, score, place = (best_of.column(c).to_numpy() for c in ("anchor", "score", "rank"))
        # An anchor with fewer positives has bands that nothing fits.
        bands = np.full((len(anchors.row), positives, 2), (NONE, -NONE), np.int64)
        bands[anchor, place - 1] = np.stack([-(-low * score // 100), high * score // 100], 1)
        cuts = spark.sparkContext.broadcast(bands)
        fit = mapped(others, lambda b, sent=sent, cuts=cuts: within_bands(sent.value, cuts.value, negatives, b), "band long, id long, score long, row long")
        of = pa.table({"of": anchor * positives + place - 1, "anchor_id": anchors.id[anchor], "positive_id": best_of.column("id"), "positive_score": score})
        named = first_of(fit, "band", negatives).join(spark.createDataFrame(of), F.col("band") == F.col("of"))
        out = out.union(saved(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        sent.destroy()
        cuts.destroy()
    dropped(rows, numbered)
    return out
