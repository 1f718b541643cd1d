"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mapped, text_bytes

#: Chunks of CHUNK bytes start every STEP bytes; a text's last chunk is padded with byte 0.
CHUNK, STEP = 512, 448
#: Filters and the bytes that each spans.
FILTERS, WIDTH = 16, 5
#: Documents whose probability lies below are rejected.
THRESHOLD = 0.7
#: Bound of the labelled rows that the classifier is fitted on; it sees all chunks of their texts.
SAMPLE = 2000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; an empty text has one chunk, of padding."""
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


def chunk_table(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all rows as rows of bytes, and the first chunk of each row (one more entry than rows)."""
    starts = [chunk_starts(n) for n in np.diff(at).tolist()]
    first = np.cumsum([0, *map(len, starts)])
    if first[-1] == 0:
        return np.zeros((0, CHUNK), np.uint8), first
    begin = np.concatenate([s + a for s, a in zip(starts, at[:-1].tolist(), strict=True)])
    end = np.repeat(at[1:], np.diff(first))
    where = begin[:, None] + np.arange(CHUNK)[None, :]
    inside = where < end[:, None]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    return np.where(inside, padded[np.minimum(where, len(data))], 0), first


@dataclass
class ByteCNN:
    """table[j, byte] holds what a byte j places into a filter's span adds to each filter."""

    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (FILTERS,)
    offset: float

    def convolve(self, chunks: np.ndarray) -> np.ndarray:
        span = chunks.shape[1] - WIDTH + 1
        out = self.table[0][chunks[:, :span]]
        for j in range(1, WIDTH):
            out += self.table[j][chunks[:, j : j + span]]
        return out

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each chunk's filters at their maximum, rectified."""
        parts = [self.convolve(chunks[i : i + 32]).max(1) for i in range(0, len(chunks), 32)]
        best = np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)
        return np.tanh(np.maximum(best + self.bias, 0))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One probability per row: the mean of its chunks' pooled filters through a logistic unit."""
        out = []
        chunks, first = chunk_table(data, at)
        pooled = self.pooled(chunks).astype(np.float64)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            out.append(float(pooled[lo:hi].mean(0) @ self.weight) + self.offset)
        return 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))


def fit(texts: list[str | None], labels: list[int], epochs: int = 14, rate: float = 0.02, seed: int = 7) -> ByteCNN:
    """Adam on the mean log loss; dropout on pooled filters. No rows, or one class only: the classifier gives that class's share everywhere."""
    rng = np.random.default_rng(seed)
    net = ByteCNN(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.5, FILTERS).astype(np.float32), 0.0)
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        net.weight[:] = 0
        net.offset = 0.0 if len(y) == 0 else 4.0 * (2 * float(y[0]) - 1)
        return net
    raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("table", net.table), ("bias", net.bias), ("weight", net.weight))}
    offset_state, t = [0.0, 0.0], 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), 32):
            rows = order[lo : lo + 32]
            chunks, first = chunk_table(np.concatenate([raw[i] for i in rows]), np.cumsum([0, *(len(raw[i]) for i in rows)]))
            owner = np.repeat(np.arange(len(rows)), np.diff(first))
            parts = []
            for c in range(0, len(chunks), 64):
                conv = net.convolve(chunks[c : c + 64])
                at = conv.argmax(1)
                parts.append((at, np.take_along_axis(conv, at[:, None, :], 1)[:, 0, :]))
            where, best = (np.concatenate(x) for x in zip(*parts, strict=True))
            best += net.bias
            act = np.tanh(np.maximum(best, 0))
            per = np.bincount(owner, minlength=len(rows)).astype(np.float32)
            mean = np.zeros((len(rows), FILTERS), np.float32)
            np.add.at(mean, owner, act)
            mean /= per[:, None]
            mask = (rng.random(FILTERS) > 0.2).astype(np.float32) / 0.8
            p = 1 / (1 + np.exp(-np.clip((mean * mask) @ net.weight + net.offset, -30, 30)))
            g = ((p - y[rows]) / len(rows)).astype(np.float32)
            grad_weight = (mean * mask).T @ g + 1e-4 * net.weight
            back = (g / per)[owner][:, None] * (net.weight * mask)[None, :] * (1 - act**2) * (best > 0)
            grad_table = np.zeros_like(net.table)
            filters = np.broadcast_to(np.arange(FILTERS)[None, :], where.shape)
            for j in range(WIDTH):
                np.add.at(grad_table[j], (np.take_along_axis(chunks, where + j, 1), filters), back)
            grad_table += 1e-5 * net.table
            t += 1
            for name, grad in (("table", grad_table), ("bias", back.sum(0)), ("weight", grad_weight)):
                m, v = state[name]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad**2
                value = getattr(net, name)
                value -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
            grad = float(g.sum())
            offset_state[0] = 0.9 * offset_state[0] + 0.1 * grad
            offset_state[1] = 0.999 * offset_state[1] + 0.001 * grad**2
            net.offset -= step * (offset_state[0] / (1 - 0.9**t)) / (offset_state[1] / (1 - 0.999**t)) ** 0.5 if offset_state[1] else 0.0
    return net


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """At most `sample` labelled rows (id, text, quality), none of them held out: those of the least hashed ids. Labels that are null or neither 0 nor 1 are left out; of repeated labels of an id the least counts, of its texts the least."""
    ids = labels.select(labels[id_column].alias("id"), labels[label_column].alias("quality"))
    known = (
        ids.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")).join(F.broadcast(known), "id")  # `sample` rows
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("id", "text", "quality")


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, **columns: str) -> ByteCNN:
    rows = sorted(training_rows(documents, labels, sample, **columns).collect(), key=lambda r: zlib.crc32(str(r["id"]).encode()))
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def with_quality(documents: DataFrame, net: ByteCNN, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns with a probability that the text is of good quality.

    Null counts as the empty text, whose one chunk is padding. A column of the
    name of `score_column` is replaced. Rows keep their number and repetition.
    """
    documents = documents.drop(score_column)
    names = documents.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{score_column}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 20, text_column):
            data, at = text_bytes(b.column(b.schema.get_field_index(text_column)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.score(data, at))], names=[*names, score_column])

    return mapped(documents, run, schema)
