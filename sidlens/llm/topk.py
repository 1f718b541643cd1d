"""Exact top-k search by pivot-table elimination.

The table holds each vector's distances to pivots, of which the origin is one.
They fix the vector's place in the space that the pivots span and its distance
from that space, so the largest lower bound that they allow for the distance of a
query and a candidate is that of two points with those coordinates. It gives an
upper bound of the inner product; candidates are evaluated in the order of the
bounds until the k-th score exceeds all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, mapped, saved

#: Pivots besides the origin, and the vectors they are chosen from.
PIVOTS, PIVOT_SAMPLE = 48, 1024
#: Rows of a block of candidates and of queries, components of a block of queries at most, and queries whose bounds are held at a time.
CANDIDATES, QUERIES, NUMBERS, ROWS = 4096, 8192, 1 << 22, 256
SCALE = 256
#: More than the rounding of a bound relative to the norms, for bounds that stay bounds.
SLACK = 1e-7
#: Candidates evaluated before a query's bound is looked at again.
STEP = 32


def quantized(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x). Components that leave 31 bits are an error, for their scores would leave 64."""
    out = np.floor(vectors * float(SCALE))
    if out.size and np.abs(out).max() >= 2**31 - 1:
        raise ValueError("components of 2**23 or more can't be scored in 64 bits")
    return out.astype(np.int32)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first from a bounded sample: each next pivot lies farthest from the space that those before span."""
    left = sample.astype(np.float64)
    chosen: list[int] = []
    size = (left**2).sum(1)
    least = 1e-9 * size.max(initial=0)
    while len(chosen) < min(n, *sample.shape) and size.max(initial=0) > least:
        i = int(size.argmax())
        chosen.append(i)
        unit = left[i] / np.sqrt(size[i])
        left -= (left @ unit)[:, None] * unit
        size = (left**2).sum(1)
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: Euclidean distances of each row to the origin and each pivot."""
    a = x.astype(np.float64)
    return np.stack([np.sqrt(((a - p) ** 2).sum(1)) for p in (np.zeros(a.shape[1]), *pivots.astype(np.float64))], 1)


def coordinates(table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From a row's distances its coordinates in the space of the pivots, and last its distance from that space. The product of two rows is an upper bound of the vectors' own."""
    p = pivots.astype(np.float64)
    square = table**2
    if len(p):
        inner = (square[:, :1] + (p**2).sum(1) - square[:, 1:]) / 2
        inside = np.linalg.solve(np.linalg.cholesky(p @ p.T), inner.T).T
    else:
        inside = np.zeros((len(table), 0))
    rest = np.sqrt(np.maximum(square[:, 0] - (inside**2).sum(1), 0))
    return np.concatenate([inside, rest[:, None]], 1)


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with one vector: in doubles where no sum can leave 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ v.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        return np.array([_exact(r, v) for r in a], np.int64)
    return a.astype(np.int64) @ v.astype(np.int64)


def _exact(a: np.ndarray, v: np.ndarray) -> int:
    score = sum(x * y for x, y in zip(a.tolist(), v.tolist(), strict=True))
    if not -(2**63) <= score < 2**63:
        raise ValueError("a score leaves 64 bits")
    return score


def search_block(q_ids, q, q_at, least, ids, x, x_at, k: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query's place, vector id, score): each query's k best of one block, as far as they reach the score `least` of the query; and how many candidates were evaluated for each. At equality of bound and score the search goes on, for ties belong to the smaller id."""
    out, evaluated = [], np.zeros(len(q_ids), np.int64)
    far = np.sqrt((x_at**2).sum(1)).max(initial=0)
    slack = SLACK * (1 + np.sqrt((q_at**2).sum(1)) * far)
    for lo in range(0, len(q_ids), ROWS):
        bounds = q_at[lo : lo + ROWS] @ x_at.T + slack[lo : lo + ROWS, None]
        for i, bound in enumerate(bounds, lo):
            order = np.flatnonzero(bound >= least[i])
            order = order[np.argsort(-bound[order], kind="stable")]
            own_ids, own_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(order), STEP):
                if len(own_ids) == k and own_scores[-1] > bound[order[at]]:
                    break
                part = order[at : at + STEP]
                evaluated[i] += len(part)
                part = part[ids[part] != q_ids[i]]
                own_ids = np.concatenate([own_ids, ids[part]])
                own_scores = np.concatenate([own_scores, products(x[part], q[i])])
                best = np.lexsort((own_ids, -own_scores))[:k]
                own_ids, own_scores = own_ids[best], own_scores[best]
            out += [(i, int(a), int(s)) for a, s in zip(own_ids, own_scores, strict=True)]
    return out, evaluated


def searcher(sent, k: int):
    """A mapper from blocks of candidates to (query_id, vec_id, score): the k best of each query of a block among all that the task reads, and a row without a vector whose score counts what was evaluated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        q_ids = np.frombuffer(f["q_ids"], np.int64)
        table = lambda raw, n, kind: np.frombuffer(raw, kind).reshape(n, -1)
        q, q_at = table(f["q_v"], len(q_ids), np.int32), table(f["q_at"], len(q_ids), np.float64)
        least, evaluated = np.frombuffer(f["q_least"], np.int64).copy(), np.zeros(len(q_ids), np.int64)
        held = np.zeros((0, 3), np.int64)
        for b in batches:
            for x_ids, x, x_at in zip(*b.columns, strict=True):
                ids = np.frombuffer(x_ids.as_buffer(), np.int64)
                own, some = search_block(q_ids, q, q_at, least, ids, table(x.as_buffer(), len(ids), np.int32), table(x_at.as_buffer(), len(ids), np.float64), k)
                evaluated += some
                held = np.concatenate([held, np.array(own, np.int64).reshape(-1, 3)])
                held = held[np.lexsort((held[:, 1], -held[:, 2], held[:, 0]))]
                place = np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0], "left")
                held, last = held[place < k], held[place == k - 1]
                least[last[:, 0]] = np.maximum(least[last[:, 0]], last[:, 2])
        names = ["query_id", "vec_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[held[:, 0]]), pa.array(held[:, 1]), pa.array(held[:, 2])], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.nulls(len(q_ids), pa.int64()), pa.array(evaluated)], names=names)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", count_evaluated: bool = False) -> DataFrame:
    """Per query its k best other rows by exact inner product of quantized vectors: query_id, rank, vec_id, score; with count_evaluated also `evaluated`, the candidates whose product was taken.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id; a null condition is no query. Vectors meet
    those of their own length. Rows that share the query's id are its own;
    repeated candidates count each; queries of one id and vector are one, and
    those of one id share a ranking. Ties go to the smaller id. Fewer
    candidates than k: all of them. Components of 2**23 or more are an error.

    Rows are packed into blocks. Blocks of queries, of bounded size, are given to
    all tasks one after the other; candidates stay where they are, and a task sends
    each query's best of all blocks that it reads. A query's k-th score among a
    bounded sample, and then among what the task has seen, is the least that a
    candidate has to reach.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = saved(rows.where(usable), "vectors")
    schema = "query_id long, rank int, vec_id long, score long" + ", evaluated long" * count_evaluated
    counted = rows.agg(F.count("*").alias("rows"), F.count_if("q").alias("queries")).first()
    if not counted["queries"]:
        return spark.createDataFrame([], schema)
    sample: dict[int, list] = {}
    for r in rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
    known = {n: (np.array([i for i, _ in s]), quantized(np.array([v for _, v in s], np.float64))) for n, s in sample.items()}
    pivots_of = {n: choose_pivots(x) for n, (_, x) in known.items()}
    n_c, n_q = max(1, -(-counted["rows"] // CANDIDATES)), max(1, -(-counted["queries"] // QUERIES))

    def at_least(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The k-th score of each query among the sample, which all candidates that count reach; the least number where it has fewer."""
        dim = x.shape[1]
        out = np.full(len(ids), np.iinfo(np.int64).min)
        if dim in known:
            own, y = known[dim]
            for i in range(len(ids)):
                scores = products(y, x[i])[own != ids[i]]
                if len(scores) >= k:
                    out[i] = np.partition(scores, -k)[-k]
        return out

    def packed(side: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = CANDIDATES if side == "c" else QUERIES
            names = ["dim", *(f"{side}_{c}" for c in ("ids", "v", "at", "least"))]

            def emit(dim: int, part: list) -> pa.RecordBatch:
                i, x = np.array([p[0] for p in part], np.int64), quantized(np.array([p[1] for p in part], np.float64))
                pivots = pivots_of.get(dim, np.zeros((0, dim), np.int32))
                least = at_least(i, x) if side == "q" else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([z.tobytes()], pa.binary()) for z in (i, x, coordinates(distances(x, pivots), pivots), least))], names=names)

            held: dict[int, list] = {}
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    part = held.setdefault(len(v), [])
                    part.append((i, v))
                    if len(part) >= (most if side == "c" else max(1, min(most, NUMBERS // len(v)))):
                        yield emit(len(v), held.pop(len(v)))
            for dim, part in held.items():
                yield emit(dim, part)

        return run

    def blocks_of(side: str, kept: DataFrame, n: int) -> DataFrame:
        columns = ", ".join(f"{side}_{c} binary" for c in ("ids", "v", "at", "least"))
        # As many blocks of queries as they need, for each takes a pass.
        dealt = kept.repartition(n) if side == "q" else kept.repartition(n, F.xxhash64("id"))
        return saved(mapped(dealt, packed(side), f"dim int, {columns}"), f"blocks-{side}")

    c, q = blocks_of("c", rows.select("id", "v"), n_c), blocks_of("q", rows.where("q").select("id", "v").distinct(), n_q)
    q = saved(q.withColumn("place", F.monotonically_increasing_id()), "queries")
    found: list[DataFrame] = []
    for place in sorted(r["place"] for r in q.select("place").collect()):
        block = q.where(F.col("place") == place).first()
        sent = spark.sparkContext.broadcast(block.asDict())
        own = c.where(F.col("dim") == block["dim"]).select("c_ids", "c_v", "c_at")
        found.append(saved(mapped(own, searcher(sent, k), "query_id long, vec_id long, score long"), "best"))
        sent.destroy()
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    dropped(rows, c, q)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = best.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    if count_evaluated:
        out = out.join(best.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").alias("evaluated")), "query_id").select("query_id", "rank", "vec_id", "score", "evaluated")
    return out
