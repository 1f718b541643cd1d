"""SimHash near-duplicates: fingerprints of shingles, pairs by shared blocks, exact Hamming distances, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, blocks, components, dropped, mapped, saved, text_bytes, word_places

BITS = 64
#: Fingerprints differ in so many bits at most if they link.
RADIUS = 3
SEED = 42
#: Shingles hashed at a time.
SOME = 1 << 16
#: Members of a bucket that one task compares. More are dealt into cells of two parts each, up to WHOLE; a larger bucket is split by further bits, while it has more than LEAST_BITS of them.
BUCKET, WHOLE, LEAST_BITS = 1024, 1 << 16, 16
#: Groups of up to so many members are compared side by side, larger ones member by member.
SIDE_BY_SIDE = 8
#: Cost of a bucket's entry, in comparisons of two fingerprints.
ENTRY = 100.0


def shingle_bytes(data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all rows, A-Z lower-cased, with one space after each: the bytes, where each word starts and ends, and each row's first word (one more entry than rows)."""
    starts, ends = word_places(data, at)
    size = ends - starts
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1].astype(np.int64)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + within] = _LOWER[data[np.repeat(starts, size) + within]]
    return out.tobytes(), begin, begin + size, np.searchsorted(starts, at, "left")


def fingerprints(data: np.ndarray, at: np.ndarray, words: int = 3) -> np.ndarray:
    """A fingerprint for each row: bit i is 1 if more than half of the shingles' hashes (XXH64, seed SEED) have it. Fewer words than a shingle has: all of them as one; no word: zero."""
    text, begin, end, first = shingle_bytes(data, at)
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(at) - 1, np.uint64)
    for r, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if hi == lo:
            continue
        width = min(words, hi - lo)
        n = hi - lo - width + 1
        ones = np.zeros(BITS, np.int64)
        for a in range(lo, lo + n, SOME):
            b = min(a + SOME, lo + n)
            places = zip(begin[a:b].tolist(), end[a + width - 1 : b + width - 1].tolist(), strict=True)
            h = np.fromiter((digest(text[i:j], SEED) for i, j in places), np.uint64, b - a)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[r] = (np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64)
    return out


def with_fingerprints(documents: DataFrame, words: int = 3, text_column: str = "text", name: str = "fp") -> DataFrame:
    """The rows with a column of signed 64-bit fingerprints."""
    at = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 4 << 20, text_column):
            held = [c for i, c in enumerate(b.columns) if i != at]
            fps = fingerprints(*text_bytes(b.column(at)), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*held, pa.array(fps)], names=[*(n for i, n in enumerate(b.schema.names) if i != at), name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != text_column)
    return mapped(documents, run, f"{schema}, `{name}` long" if schema else f"`{name}` long")


def block_masks(n_blocks: int, fixed: int = 0) -> list[int]:
    """Masks of `fixed` and any n_blocks - RADIUS of the n_blocks blocks that the other bits make: whatever RADIUS bits differ, one of them is untouched."""
    bits = [b for b in range(BITS) if not fixed >> b & 1]
    cuts = [len(bits) * i // n_blocks for i in range(n_blocks + 1)]
    parts = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return [fixed + sum(c) for c in combinations(parts, n_blocks - RADIUS)]


def blocks_for(n: int) -> int:
    """How many blocks cost least for n fingerprints, were they spread evenly: entries against comparisons within buckets."""
    return min(range(RADIUS + 1, 13), key=lambda k: comb(k, RADIUS) * n * (ENTRY + n / 2.0 ** (BITS * (k - RADIUS) // k)))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between different fingerprints of one bucket that connect whatever links there, and no more than that takes: each member is compared with those not reached yet."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                met = left[near]
                queue += list(met)
                a.append(np.full(len(met), x))
                b.append(met)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def bucket_links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal keys."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    of = np.repeat(np.where(size <= SIDE_BY_SIDE, size, 0), size)
    a, b = [], []
    for step in range(1, SIDE_BY_SIDE):
        i = np.flatnonzero((of[:-step] > step) & (key[:-step] == key[step:])) if len(key) > step else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= RADIUS]
        a.append(fps[i])
        b.append(fps[i + step])
    for lo, n in zip(edge[size > SIDE_BY_SIDE].tolist(), size[size > SIDE_BY_SIDE].tolist(), strict=True):
        x, y = forest(fps[lo : lo + n])
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows (bucket, fp) that come sorted by bucket; a bucket holds about BUCKET rows at most."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        key, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        held.append((key, fps))
        if len(key) and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1], "left"))
            done = [*held[:-1], (key[:cut], fps[:cut])]
            held = [(key[cut:], fps[cut:])]
            yield _found(*bucket_links(*(np.concatenate(x) for x in zip(*done, strict=True))))
    if held:
        yield _found(*bucket_links(*(np.concatenate(x) for x in zip(*held, strict=True))))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges between different fingerprints `fp`, RADIUS bits apart at most, that connect whatever such pairs connect; not all pairs.

    Fingerprints meet where they share all bits of a mask. Of buckets too large for
    one task, no pair is lost either: they are dealt into cells, or split by the same
    rule over the bits that the mask leaves.
    """
    spark = fps.sparkSession
    masks = block_masks(blocks_for(fps.count()))
    entries = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    meeting, held = None, []
    while True:
        entries = entries.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = saved(entries.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        full = entries.join(sizes, ["mask", "value"])
        split = (F.col("size") > WHOLE) & (BITS - F.bit_count("mask") > LEAST_BITS)
        parts = F.when(F.col("size") > BUCKET, F.ceil(2 * F.col("size") / BUCKET)).otherwise(1)
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        met = full.where(~split).withColumn("parts", parts).withColumn("own", own).select("mask", "value", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        met = saved(met.select(F.xxhash64("mask", "value", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp"), "met")
        held += [sizes, met]
        meeting = met if meeting is None else meeting.union(met)
        # Masks are as many as the blocks have sets, whatever the rows.
        large = [r["mask"] for r in sizes.where(split).select("mask").distinct().collect()]
        if not large:
            break
        finer = spark.createDataFrame([(m, signed(f)) for m in large for f in block_masks(RADIUS + 1, m % (1 << BITS))], "mask long, finer long")
        entries = saved(full.where(split).select("mask", "fp").join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")), "finer")
        held.append(entries)
    out = saved(mapped(meeting.repartition("bucket").sortWithinPartitions("bucket"), _in_buckets, "a long, b long").distinct(), "near")
    dropped(*held)
    return out


def similar_components(documents: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, the least id that links of fingerprints RADIUS bits apart at most reach.

    Null and blank texts have fingerprint zero, which links like any other. Repeated
    rows and ids count each; rows of a null id are linked like others, and a
    component of such rows alone has a null id. Other columns don't count.
    """
    rows = saved(with_fingerprints(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), words), "printed")
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    near = links(prints.select("fp"))
    roots = components(near)
    known = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = saved(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = saved(known.join(least, "root").select("fp", "component_id"), "components")
    dropped(prints, near, known)
    return rows.join(of, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
