"""Repeated byte strings, found by interval expansion on a Burrows-Wheeler transform.

A string of `length` bytes that occurs twice has, at the same place in both
occurrences, the same least-hashed gram. So the texts are cut into contexts,
each of the strings that share one least gram; contexts of equal grams form a
group, equal ones are counted as one, and each group's contexts become one text
whose transform is expanded breadth first: backward extension finds common
prefixes by increasing value and ends at `length`. What is still undivided there
repeats. Words can stand in for bytes: then a text is the sequence of its words'
hashes, and white space doesn't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, mapped, mix, saved, text_bytes, unused, word_hashes, word_places
from .jaccard_join import grouped

_U = np.uint64
LENGTH = 400
#: Contexts of a group beyond which it is cut by what surrounds the gram; beyond it again, strings are counted one by one.
GROUP = 2048
#: Parts of the offsets for that, and bytes of contexts that are transformed together.
PARTS, BLOCK = 8, 1 << 17
#: Repeated strings of a corpus, as rows of 32 bytes, up to which they are broadcast.
MOST_BROADCAST = 200_000
#: Bits of the filter that tells which texts surely have no part in a join; of fixed size, it lets more through as it fills.
FILTER_BITS = 1 << 23
#: Low bits of a gram's hash that give way to its place when the least is sought.
_PLACE = _U(31)


# ---------------------------------------------------------------- anchors


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


_MULT = _U(0x9E3779B97F4A7C15)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours: a polynomial, so that it rolls. It only chooses and groups; grams that collide share a group, where bytes decide."""
    n = len(symbols)
    power, inverse = (np.cumprod(np.concatenate(([_U(1)], np.full(n, base, _U))), dtype=_U) for base in (_MULT, _U(pow(int(_MULT), -1, 1 << 64))))
    prefix = np.zeros(n + 1, _U)
    np.cumsum(symbols * power[:n], out=prefix[1:], dtype=_U)
    return mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Data: bytes, or hashes of words, which then count for bytes. Of each run of strings of `length` bytes within one row that share their least gram, the leftmost of equal ones: (row, start of the gram in the row, hash of the gram, hash of the context, bytes of it before the gram, its bytes)."""
    k = length // 4
    w = length - k + 1
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, _U, _U, np.int64, np.int64))
    grams = gram_hashes(mix(np.arange(1, 257, dtype=_U) * _MULT)[data] if data.dtype == np.uint8 else data, k)
    placed = ((grams >> _PLACE) << _PLACE) | np.arange(n - k + 1, dtype=_U)
    least = (sliding(placed, w, np.minimum) & _U((1 << int(_PLACE)) - 1)).astype(np.int64)  # of the string that starts at each byte
    row = np.searchsorted(at, np.arange(n - length + 1), "right") - 1
    valid = np.flatnonzero(np.arange(n - length + 1) + length <= at[row + 1])
    if not len(valid):
        return anchors(data[:0], at[:1], length)
    least, row = least[valid], row[valid]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]))))
    first, last = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    gram, row, end = least[new], row[new], last + length
    unit = data.dtype.itemsize
    raw = data.tobytes()
    held = np.frombuffer(b"".join(hashlib.blake2b(raw[a:z], digest_size=8).digest() for a, z in zip((first * unit).tolist(), (end * unit).tolist(), strict=True)), "<u8")
    context = mix(held + (gram - first).astype(_U) * _MULT)
    return row, gram - at[row], grams[gram], context, gram - first, end - first


# ---------------------------------------------------------------- the transform


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by doubling. The last symbol is 0 and the only one."""
    bits = max(9, int(symbols.max()).bit_length())
    n, k = len(symbols), 63 // bits
    padded = np.concatenate([symbols, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << bits) | padded[j : j + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


def undivided(symbols: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, whether each suffix shares at least `bound` symbols with the one before it).

    Breadth-first backward extension: a boundary between suffixes whose common
    prefix is v lets the boundaries that it extends to by one symbol have v + 1.
    Where both neighbours are preceded by one symbol there is one such boundary,
    reached by the LF mapping; the others, at the heads of runs of the
    transform, are reached as soon as a boundary falls between the last two
    suffixes that their symbol precedes.
    """
    n = len(symbols)
    order = suffix_array(symbols)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt.astype(np.int16) if symbols.max() < 1 << 15 else bwt, kind="stable")  # row j of the first column is row by_symbol[j] of the last
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    known = np.zeros(n, bool)
    first = symbols[order]
    frontier = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))  # common prefix 0
    known[frontier] = True
    same = np.zeros(n, bool)
    same[1:] = bwt[1:] == bwt[:-1]
    heads = np.flatnonzero(~known & (np.concatenate(([0], by_symbol[:-1])) + 1 != by_symbol))
    for _ in range(1, bound):
        if not len(frontier):
            break
        reach = lf[frontier[same[frontier]]]
        reach = reach[~known[reach]]
        known[reach] = True
        heads = heads[~known[heads]]
        if len(heads):
            if len(frontier) * 16 > n:
                passed = np.zeros(n, np.int32)
                passed[frontier] = 1
                np.cumsum(passed, out=passed)
                cut = passed[by_symbol[heads]] > passed[by_symbol[heads - 1]]
            else:
                cut = np.searchsorted(frontier, by_symbol[heads], "right") > np.searchsorted(frontier, by_symbol[heads - 1], "right")
            found, heads = heads[cut], heads[~cut]
            known[found] = True
            reach = np.concatenate([reach, found])
        frontier = np.sort(reach)
    return order, ~known


def repeated_starts(contexts: list[bytes], group: np.ndarray, left: np.ndarray, length: int, unit: int = 1) -> list[np.ndarray]:
    """For each context the starts of its strings of `length` symbols, of `unit` bytes each (1 or 8), that another context of its group holds at the same distance from the gram."""
    sizes = np.array([len(c) // unit for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    held = np.frombuffer(b"".join(contexts), np.uint8 if unit == 1 else _U)
    text = np.ones(int(ends[-1]) + 2, np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = inner[-1] = False
    text[inner] = (held.astype(np.int64) if unit == 1 else np.unique(held, return_inverse=True)[1]) + 2
    text[-1] = 0
    order, same = undivided(text, length)
    which = np.minimum(np.searchsorted(ends, order), len(contexts) - 1)
    start = order - (ends[which] - sizes[which])
    alike = np.cumsum(~same)
    fits = start + length <= sizes[which]
    which, start, alike = which[fits], start[fits], alike[fits]
    key = np.stack([alike, group[which], left[which] - start])
    by = np.lexsort(key)
    k = key[:, by]
    new = np.ones(len(by), bool)
    new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
    count = np.diff(np.append(np.flatnonzero(new), len(by)))
    twice = by[np.repeat(count > 1, count)]
    out = [np.zeros(0, np.int64)] * len(contexts)
    order = twice[np.lexsort((start[twice], which[twice]))]
    for rows in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
        if len(rows):
            out[which[rows[0]]] = start[rows]
    return out


def united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return list(zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True))


# ---------------------------------------------------------------- rows


def _lo(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of the hashes `lo` of texts; the driver gets FILTER_BITS / 64 numbers at most."""
    bit = F.pmod(F.col("lo"), F.lit(FILTER_BITS))
    words = keys.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(lo, {FILTER_BITS}) % 64 as int))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words:
        out[r["w"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def _in_filter(bits: np.ndarray, lo: list[int]) -> np.ndarray:
    at = np.array(lo, np.int64) % FILTER_BITS
    return (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1


def repeated_spans(documents: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", words: bool = False) -> DataFrame:
    """(id, lo, spans): of each row that has repeated bytes, the runs to remove, as arrays of (from, to) in UTF-8 bytes, in any order and overlapping. `lo` is a hash of the text, for ids that repeat. With words, `length` and the runs count words."""
    unit = 8 if words else 1
    rows = _rows(documents, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 17):
            data, at = text_bytes(b.column(1))
            row, start, gram, context, before, size = anchors(*(word_hashes(data, at, False) if words else (data, at)), length)
            raw = data.tobytes()
            lo = np.array([_lo(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(lo[row]), *(pa.array(x.astype(np.int32)) for x in (start, before, size))], names=["gram", "context", "id", "lo", "start", "before", "size"])

    occurring = saved(mapped(rows, anchored, f"gram long, context long, id {kind}, lo long, start int, before int, size int"), "occurrences")
    # Equal contexts are one; where it occurs more than once all of it repeats. Counts are summed before they are dealt out, so a frequent gram or context is no task's burden.
    one = [F.first(c).alias(c) for c in ("id", "lo", "start", "before", "size")]
    distinct = saved(occurring.groupBy("gram", "context").agg((F.count("*") > 1).alias("all"), *one), "contexts")
    # A group of contexts that all occur more than once has nothing more to say, nor has one context alone.
    asking = distinct.groupBy("gram").agg(F.count("*").alias("c"), F.min("all").alias("known")).where("c > 1 AND NOT known")
    open_ = saved(distinct.join(asking, "gram").select("gram", "context", "all", (F.col("c") > GROUP).alias("large"), "id", "lo", "start", "before", "size"), "open")
    asked = open_.groupBy("id", "lo").agg(F.collect_list(F.struct("gram", "context", "all", "large", "start", "before", "size")).alias("asked"))
    ask = asked.select(F.col("id").alias("of"), F.col("lo").alias("of_lo"), "asked").join(_possible(rows, _filter(open_)), F.col("of").eqNullSafe(F.col("id")) & (F.col("of_lo") == F.col("lo"))).select("lo", "asked", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contexts' bytes, each under the key of its group. Those of large groups go under finer keys, one for each part of the offsets, that also hash what all strings of that part share."""
        for b in blocks(batches, 1 << 19):
            out: dict[tuple, tuple] = {}
            for lo, asked, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                if words:
                    raw = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), False)[0].tobytes()
                for a in asked:
                    p = a["start"]
                    begin = p - a["before"]
                    end = begin + a["size"]
                    if not a["large"]:
                        out[a["gram"], a["context"], 0] = (a["gram"], a["context"], a["all"], p - begin, raw[begin * unit : end * unit])
                        continue
                    most_before = length - length // 4
                    step = -(-(most_before + 1) // PARTS)
                    for part, least in enumerate(range(0, most_before + 1, step)):
                        most = min(most_before, least + step - 1)
                        # Strings that start `least` to `most` before the gram, as far as the context holds them.
                        s, e = max(begin, p - most), min(end, p - least + length)
                        if e - s < length:
                            continue
                        core = _lo(b"%d,%d:" % (a["gram"], part) + raw[(p - least) * unit : (p - most + length) * unit])
                        out[core, a["context"], part] = (core, a["context"], a["all"], p - s, raw[s * unit : e * unit], a["gram"])
            values = [(v[0], v[5] if len(v) > 5 else v[0], *v[1:5]) for v in out.values()]
            key, gram, context, whole, left, raw = zip(*values, strict=True) if values else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(gram, pa.int64()), pa.array(context, pa.int64()), pa.array(whole, pa.bool_()), pa.array(left, pa.int64()), pa.array(raw, pa.binary())], names=["key", "gram", "context", "all", "left", "raw"])

    windows = saved(mapped(ask, cut, "key long, gram long, context long, all boolean, left long, raw binary"), "windows")
    # Cut groups that are large still.
    huge = windows.where(F.col("key") != F.col("gram")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("key")
    huge = saved(huge, "huge")
    few = windows.join(huge, "key", "left_anti").repartition("key").sortWithinPartitions("key", "gram", "context")

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, context, spans relative to the gram) of contexts that others of their group repeat."""

        def solve(tables: list[pa.Table]) -> pa.RecordBatch:
            group = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
            t = pa.concat_tables(tables).combine_chunks()
            # Rows of one id and text give a window each.
            new = np.ones(t.num_rows, bool)
            for c in (group, *(t[c].to_numpy() for c in ("gram", "context"))):
                new[1:] &= c[1:] == c[:-1]
            new[1:] = ~new[1:]
            t, group = t.filter(pa.array(new)), group[new]
            left = t["left"].to_numpy()
            found = repeated_starts(t["raw"].to_pylist(), group, left, length, unit)
            gram, context, whole = t["gram"].to_pylist(), t["context"].to_pylist(), t["all"].to_pylist()
            g, c, f, e = [], [], [], []
            for i, starts in enumerate(found):
                if whole[i]:
                    continue
                for a, z in united(starts - left[i], starts - left[i] + length):
                    g.append(gram[i])
                    c.append(context[i])
                    f.append(a)
                    e.append(z)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g, c, f, e)], names=["gram", "context", "from", "to"])

        held: list[pa.Table] = []
        size, waiting = 0, []
        for tables in grouped(batches, ["key"], held):
            for t in tables:
                waiting.append(t)
                size += pa.compute.sum(pa.compute.binary_length(t["raw"])).as_py()
                if size > BLOCK:
                    yield solve(waiting)
                    size, waiting = 0, []
        if waiting:
            yield solve(waiting)

    spans = mapped(few, expanded, "gram long, context long, `from` long, `to` long")
    spans = spans.union(_counted(windows.join(huge, "key", "left_semi").dropDuplicates(["key", "gram", "context"]), length, unit))
    spans = spans.union(distinct.where("all").select("gram", "context", (-F.col("before")).cast("long").alias("from"), (F.col("size") - F.col("before")).cast("long").alias("to")))
    spans = saved(spans, "found")
    if (n := spans.count()) <= MOST_BROADCAST:
        out = _looked_up(rows, spans, n, anchored)
    else:
        # A row for each occurrence of a context that repeats, as many as the texts have.
        hit = occurring.select("gram", "context", "id", "lo", "start").join(spans, ["gram", "context"]).select("id", "lo", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))
        out = hit.groupBy("id", "lo").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    out = saved(out, "spans")
    dropped(occurring, distinct, open_, windows, huge, spans)
    return out


def _looked_up(rows: DataFrame, spans: DataFrame, n: int, anchored) -> DataFrame:
    """(id, lo, spans) as repeated_spans, where all that repeats is few enough, n rows, to be at hand in each task: contexts are looked up as the texts are read."""
    found = np.array([tuple(r) for r in spans.select("context", "gram", "from", "to").collect()], np.int64).reshape(n, 4)
    shared = rows.sparkSession.sparkContext.broadcast(found[np.lexsort((found[:, 1], found[:, 0]))])  # 32 bytes a row
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        context = np.ascontiguousarray(known[:, 0])
        for b in anchored(batches):
            own = b.column(1).to_numpy()
            lo, hi = np.searchsorted(context, own, "left"), np.searchsorted(context, own, "right")
            row = np.repeat(np.arange(len(own)), hi - lo)
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(row))
            right = known[at, 1] == b.column(0).to_numpy()[row]
            row, at = row[right], at[right]
            # Rows of a batch come text by text.
            start, text = b.column(4).to_numpy()[row], b.column(3).to_numpy()[row]
            ids = b.column(2).take(pa.array(row))
            new = np.concatenate(([True], text[1:] != text[:-1])) if len(row) else np.zeros(0, bool)
            if len(row) > 1:
                same_id = pa.compute.fill_null(pa.compute.equal(ids.slice(1), ids.slice(0, len(row) - 1)), False).to_numpy(zero_copy_only=False)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= ~(same_id | (null[1:] & null[:-1]))
            edge = np.append(np.flatnonzero(new), len(row))
            pairs = pa.StructArray.from_arrays([pa.array(start + known[at, 2]), pa.array(start + known[at, 3])], names=["from", "to"])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(edge[:-1])), pa.array(text[edge[:-1]]), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pairs)], names=["id", "lo", "spans"])

    # Rows of one id and text have the same spans.
    return mapped(rows, run, f"id {kind}, lo long, spans array<struct<`from`: long, `to`: long>>").dropDuplicates(["id", "lo"])


def _counted(contexts: DataFrame, length: int, unit: int) -> DataFrame:
    """(gram, context, from, to) of the strings that several windows (key, gram, context, left, raw) of one key hold at the same distance from the gram. They share all but the ends of these strings, so each window has few; their counts are summed before they are dealt out."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, start, digest = [], [], []
            for i, (left, raw) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                for s in range(len(raw) // unit - length + 1):
                    own.append(i)
                    start.append(s - left)
                    digest.append(hashlib.blake2b(raw[s * unit : (s + length) * unit], digest_size=16).digest())
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(start, pa.int64()), pa.array(digest, pa.binary())], names=["key", "gram", "context", "from", "string"])

    held = mapped(contexts, strings, "key long, gram long, context long, `from` long, string binary")
    # A digest has 16 bytes; equal ones are equal strings.
    twice = held.groupBy("key", "from", "string").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return held.join(twice, ["key", "from", "string"]).select("gram", "context", "from", (F.col("from") + length).alias("to"))


def _possible(rows: DataFrame, bits: np.ndarray, wanted: bool = True, text_column: str = "text", lo: str = "lo") -> DataFrame:
    """The rows, with a column `lo`, whose texts the filter lets through; or those that it doesn't."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{lo}` long"
    names, shared = rows.columns, rows.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_lo((x or "").encode()) for x in b.column(b.schema.get_field_index(text_column)).to_pylist()]
            full = pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*names, lo])
            yield full.filter(pa.array(_in_filter(shared.value, found) == wanted))

    return mapped(rows, run, schema)


def _with_spans(documents: DataFrame, length: int, id_column: str, text_column: str, least_words: int | None = None) -> DataFrame:
    """All rows and columns, and last the spans, null for most. Texts that surely have none aren't joined."""
    spans = repeated_spans(documents, length, id_column, text_column)
    if least_words is not None:
        told = lambda df, words: df.select("id", "lo", F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), F.lit(words).alias("words"))).alias("spans"))
        parts = spans, repeated_spans(documents, least_words, id_column, text_column, words=True)
        both = told(parts[0], False).union(told(parts[1], True))
        spans = saved(both.groupBy("id", "lo").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
        dropped(*parts)
    bits = _filter(spans)
    lo, own, of, found = (unused(c, documents.columns) for c in ("lo", "id", "of", "spans"))
    spans = spans.select(F.col("id").alias(own), F.col("lo").alias(of), F.col("spans").alias(found))
    rows = _possible(documents, bits, True, text_column, lo)
    joined = rows.join(spans, (F.col(of) == F.col(lo)) & F.col(own).eqNullSafe(F.col(id_column)), "left").drop(own, of, lo)
    others = _possible(documents, bits, False, text_column, lo).drop(lo).withColumn(found, F.lit(None).cast(joined.schema[found].dataType))
    return joined.unionByName(others)


def _merged(spans, n: int) -> list[tuple[int, int]]:
    if not spans:
        return []
    a = np.array([(s["from"], s["to"]) for s in spans], np.int64)
    return [(s, min(e, n)) for s, e in united(a[:, 0], a[:, 1])]


def _in_bytes(spans, raw: bytes) -> list[dict]:
    """Spans of which some may count words, all in bytes."""
    if not any("words" in s and s["words"] for s in spans):
        return spans
    starts, ends = word_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [{"from": int(starts[s["from"]]), "to": int(ends[s["to"] - 1])} if s["words"] else s for s in spans]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def measure_repeats(documents: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", least_words: int | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256 of what stays; with least_words also n_repeated_words.

    Removed is each byte that lies in a string of `length` bytes which also
    starts anywhere else, in the same text or another; strings lie within one
    text. n_repeated_words counts the words in runs of least_words words that
    start anywhere else, however few bytes they have; white space between them
    doesn't count. Null counts as empty; repeated rows repeat each other; null
    ids are ids like others; other columns are ignored.
    """
    rows = _with_spans(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), length, "id", "text", least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            n, gone, many, digest, repeated = [], [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                merged = _merged([s for s in spans or [] if not s.get("words")], len(raw))
                n.append(len(raw))
                gone.append(sum(e - s for s, e in merged))
                many.append(len(merged))
                digest.append(hashlib.sha256(_kept(raw, merged)).hexdigest())
                repeated.append(sum(e - s for s, e in _merged([s for s in spans or [] if s.get("words")], len(raw))))
            columns = [b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, many)), pa.array(digest, pa.string()), pa.array(repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_repeated_words"] if least_words else [])]
    return mapped(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated_words long" * bool(least_words))


def without_repeats(documents: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", count_column: str | None = "n_chars", least_words: int | None = None) -> DataFrame:
    """All rows and columns, texts without what repeats: strings of `length` bytes, and with `least_words` also runs of that many words, whatever their bytes. A character that loses any byte goes as a whole; null stays null. `count_column`, if present, follows the new length."""
    rows = _with_spans(documents, length, id_column, text_column, least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, column=text_column):
            i = b.schema.get_field_index(text_column)
            new = []
            for text, spans in zip(b.column(i).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is None or not spans:
                    new.append(text)
                    continue
                raw = text.encode()
                new.append(_kept(raw, _merged(_in_bytes(spans, raw), len(raw))).decode("utf-8", "ignore"))
            columns = [pa.array(new, b.schema.field(j).type) if j == i else b.column(j) for j in range(b.num_columns - 1)]
            k = b.schema.get_field_index(count_column) if count_column else -1
            if k >= 0:
                columns[k] = pa.array([None if x is None else len(x) for x in new]).cast(b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([b.schema.field(j) for j in range(b.num_columns - 1)]))

    return mapped(rows, run, documents.schema)
