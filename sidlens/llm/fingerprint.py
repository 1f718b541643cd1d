"""Bottom-k sketches of shingle hashes: fingerprints that merge across parts."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mapped, shingles, text_bytes

#: Hashes kept, bits of each, words in a shingle.
K, BITS, WORDS = 128, 48, 5
#: Ranges that the order of ids is dealt to, at most, a task each: the driver gets a row for each of them. Sampled keys for their borders, which only decide how even they are.
MOST_RANGES, BORDER_SAMPLE = 1 << 15, 1 << 18


@dataclass(frozen=True)
class Sketch:
    """The least K distinct shingle hashes, ascending. With fewer than K of them the sketch is the whole set, and what it says is exact."""

    hashes: np.ndarray
    k: int = K

    @classmethod
    def of(cls, shingle_hashes: np.ndarray, k: int = K) -> Sketch:
        h = shingle_hashes >> np.uint64(64 - BITS)  # ascending input stays so
        h = h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h
        return cls(h[:k], k)

    @property
    def whole(self) -> bool:
        return len(self.hashes) < self.k

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both sets together."""
        return Sketch(np.union1d(self.hashes, other.hashes)[: self.k], self.k)

    def distinct(self) -> float:
        """The number of distinct shingles: exact for whole sets, else (k - 1) over the k-th hash as a share of all."""
        return float(len(self.hashes)) if self.whole else (self.k - 1) * 2.0**BITS / (float(self.hashes[-1]) + 1)

    def resemblance(self, other: Sketch) -> float:
        """Jaccard similarity: the share of the union's sketch that both hold. Two empty sets resemble each other fully, an empty and another not at all."""
        union = self.merge(other).hashes
        if not len(union):
            return 1.0
        both = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float(np.isin(union, both, assume_unique=True).mean())

    def containment(self, other: Sketch) -> float:
        """The share of this set that the other holds; 1 for an empty set."""
        if not len(self.hashes):
            return 1.0
        union = self.merge(other)
        return min(1.0, self.resemblance(other) * union.distinct() / self.distinct())

    def __str__(self) -> str:
        return self.hashes.astype(">u8").tobytes().hex() if BITS > 56 else "".join(f"{int(h):0{BITS // 4}x}" for h in self.hashes)

    @classmethod
    def parse(cls, text: str, k: int = K) -> Sketch:
        w = BITS // 4
        return cls(np.array([int(text[i : i + w], 16) for i in range(0, len(text), w)], np.uint64), k)


def sketches(column: pa.Array, k: int = K, words: int = WORDS) -> list[Sketch]:
    data, at = text_bytes(column)
    return [Sketch.of(h, k) for h in shingles(data, at, words)]


def fingerprints(documents: DataFrame, k: int = K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, `fingerprint` and `n_shingles`, the estimated number of distinct five-word shingles.

    Null and empty texts have the empty fingerprint. Words are runs of other
    than ASCII white space, A-Z lower-cased; with fewer than five, all of them
    are one shingle. Equal texts have equal fingerprints.
    """
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 20):
            found = sketches(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(str, found), pa.string()), pa.array([s.distinct() for s in found])], names=[id_column, "fingerprint", "n_shingles"])

    return mapped(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, fingerprint string, n_shingles double")


def edit(text: str, after: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many (or all) of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def likeness_to_edited(documents: DataFrame, k: int = K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, which borrows from the next row by ascending id (after the last: the first).

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty; null ids come first; rows
    of equal id follow each other by a hash of the text. A single row is its own
    next. Ids are numbers, texts or whatever Python orders as Spark does.

    Rows are dealt to ranges of the order, one task each, and the first row of
    each range is also given to the range before.
    """
    import zstandard

    text = F.coalesce(documents[text_column], F.lit(""))
    rows = documents.select(documents[id_column].alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()
    n = min(MOST_RANGES, max(1, rows.rdd.getNumPartitions()))
    key = lambda i, h: (False, None, h) if i is None else (True, i, h)
    edges: list = []
    if n > 1:
        found = sorted(key(*r) for r in rows.select("id", "hash").orderBy(F.xxhash64("id", "hash")).limit(min(32 * n, BORDER_SAMPLE)).collect())
        edges = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []

    # The first key of each range that has rows: one row per range for the driver.
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(edges, key(i, h)) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.int32())], names=["id", "hash", "range"])

    ranges = mapped(rows.select("id", "hash"), binned, f"id {kind}, hash long, range int").groupBy("range")
    first = F.struct(F.col("id").isNotNull().alias("k"), "id", "hash")
    heads = {r["range"]: key(r["x"]["id"], r["x"]["hash"]) for r in ranges.agg(F.min(first).alias("x")).collect()}
    present = {r: i for i, r in enumerate(sorted(heads))}  # range numbers without gaps

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches):
            row, to, borrowed = [], [], []
            for k, at in enumerate(map(key, b.column(0).to_pylist(), b.column(2).to_pylist())):
                r = bisect_right(edges, at)
                row.append(k)
                to.append(present[r])
                borrowed.append(0)
                if at == heads[r]:
                    row.append(k)
                    to.append((present[r] - 1) % len(present))
                    borrowed.append(1)
            z = pa.array([press.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), z.take(at), pa.array(to, pa.int32()), pa.array(borrowed, pa.int32())], names=["id", "hash", "z", "range", "borrowed"])

    spread = mapped(rows, dealt, f"id {kind}, hash long, z binary, range int, borrowed int").repartitionById(max(1, len(present)), "range")
    ordered = spread.sortWithinPartitions("range", "borrowed", F.col("id").asc_nulls_first(), "hash")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()

        def pairs():
            """(id, text, the next row's text) of each row that isn't borrowed; at most one borrowed row of a range has a use."""
            last = None
            for b in batches:
                for i, z, own, borrowed in zip(b.column(0), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    if last is None and borrowed:
                        continue
                    text = unpress.decompress(z.as_py()).decode()
                    if last is not None and own == last[0]:
                        yield last[1], last[2], text
                    last = None if borrowed else (own, i.as_py(), text)

        names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def emit(part):
            ids, own, after = zip(*part, strict=True)
            new = [edit(a, b) for a, b in zip(own, after, strict=True)]
            mine, edited = sketches(pa.array(own, pa.large_string()), k), sketches(pa.array(new, pa.large_string()), k)
            # The next text of each row but the last is the row after it.
            follows = [*mine[1:], None]
            nexts = [f if f is not None and i + 1 < len(own) and own[i + 1] == after[i] else None for i, f in enumerate(follows)]
            missing = [i for i, f in enumerate(nexts) if f is None]
            for i, f in zip(missing, sketches(pa.array([after[i] for i in missing], pa.large_string()), k), strict=True):
                nexts[i] = f
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(map(len, own), pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array(map(str, mine)),
                    pa.array(map(str, edited)),
                    pa.array([a.resemblance(b) for a, b in zip(mine, edited, strict=True)]),
                    pa.array([a.resemblance(b) for a, b in zip(mine, nexts, strict=True)]),
                ],
                names=names,
            )

        part, size = [], 0
        for p in pairs():
            part.append(p)
            size += len(p[1])
            if size > 1 << 20:
                yield emit(part)
                part, size = [], 0
        if part:
            yield emit(part)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    return mapped(ordered, compared, f"`{id_column}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
