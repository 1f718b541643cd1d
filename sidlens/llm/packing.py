"""Best-fit packing of tokenized documents into sequences of bounded length.

All that the packing itself needs is how many pieces have each length, at most
`capacity` numbers. On that histogram, sets of up to three pieces that provably
dominate every alternative are fixed first (Martello and Toth's reduction), for
pieces of any length and until nothing more is fixed; then the rest goes
best-fit, longest first. The plan assigns ranks within each length to places, so
rows find their places without meeting.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, kept, mapped, saved, texts

CAPACITY = 4096
#: The id that ends each document.
END = 1
#: Words a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 500_000, 48
#: Characters at which str.split cuts a text and the vocabulary's pattern doesn't.
UNLIKE_SPACE = re.compile("[\x1c-\x1f]")


class WordBPE:
    """Ids of a word-end BPE file as the tokenizers library gives them; words are looked up, new ones are merged by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        d = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: np.uint32(t["id"]).astype("<u4").tobytes() for t in d.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # The rest of the file's own pipeline, for words with a space between them; a word's last token is one that ends words.
        cut = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.model = Tokenizer.from_str(json.dumps(d | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": cut}}))
        vocab = d["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(d["model"]["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case; white space only separates words."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, text: str) -> list[str]:
        """Words between white space. No match of the pattern has white space in it, so each word has the ids of its own."""
        text = self.normal(text)
        return self.words.findall(text) if UNLIKE_SPACE.search(text) else text.split()

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, none of which has white space in it, from the library; a few thousand go in one string."""
        lines = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
        ids = np.array([i for e in self.model.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int64)
        at = 4 * np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        raw = ids.astype("<u4").tobytes()
        return {w: raw[a:z] for w, a, z in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True)}

    def encode_many(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, cut = self.known, []
        for text in batch:
            if any(s in text for s in self.special):
                words: list[str] = []
                for part in self.cut.split(text):
                    if part in self.special:
                        known[part] = self.special[part]
                        words.append(part)
                    else:
                        words += self.split(part)
                cut.append(words)
            else:
                cut.append(self.split(text))
        new = list(set().union(*cut).difference(known))
        found = [[w] if w.isascii() and w.isalpha() else self.words.findall(w) for w in new]
        ids = self.word_ids(list(set().union(*found)))
        for w, own in zip(new, found, strict=True):
            known[w] = ids[w] if len(own) == 1 and own[0] == w else b"".join(map(ids.__getitem__, own))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out


@kept
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


# ---------------------------------------------------------------- the plan


def dominating(j: int, left: np.ndarray, capacity: int) -> list[int] | None:
    """A set of up to three lengths, j among them, that dominates all others with a piece of length j; None if no rule finds one. left: pieces of each length.

    Others that fit beside j can be put where the set's own come from, so no
    packing is worse for using the set: if nothing fits; if one more fills it
    exactly, or no two fit and it is the longest that does; or if no three fit,
    and beside the longest that fits goes one at least as long as the shorter one
    of any two.
    """
    room = capacity - j
    left = left[: room + 1].copy()
    if j <= room:
        left[j] -= 1
    fits = np.flatnonzero(left)
    if not len(fits):
        return [j]
    a = int(fits[-1])
    least = np.repeat(fits[:3], np.minimum(left[fits[:3]], 3))[:3]
    if a == room or len(least) < 2 or least[0] + least[1] > room:
        return [j, a]
    if len(least) == 3 and least.sum() <= room:
        return None
    left[a] -= 1
    beside = np.flatnonzero(left[: room - a + 1])
    left[a] += 1
    if not len(beside):
        return None
    b = int(beside[-1])
    # The shorter of any two that fit: the longest up to half the room that has another at least as long beside it, else the one below.
    half = fits[fits <= room // 2]
    longer = fits[len(half)] if len(half) < len(fits) else room + 1
    if not len(half):
        return None
    top = int(half[-1])
    shorter = top if left[top] > 1 or top + longer <= room else int(half[-2]) if len(half) > 1 else 0
    return [j, a, b] if b >= shorter else None


def reduced(left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths) that the reduction fixes; their pieces are taken from `left`."""
    out = []
    while True:
        before = len(out)
        for j in np.flatnonzero(left)[::-1].tolist():
            while left[j]:
                found = dominating(j, left, capacity)
                if found is None:
                    break
                # What made it dominate holds as long as all its lengths are there.
                k = min(int(left[n]) // found.count(n) for n in found)
                for n in found:
                    left[n] -= k
                out.append((k, sorted(found, reverse=True)))
        if len(out) == before:
            return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, list[int]]], int]:
    """(how many sequences, the lengths each holds, longest first), from how many pieces have each length; and how many of these the reduction has fixed, which come first.

    What it leaves goes best fit, longest first, where of the open sequences the
    fullest that still has room takes a piece. Pieces of one length go together,
    so the work depends on the number of lengths alone.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] += k
    out = reduced(left, capacity)
    fixed = len(out)
    # Best fit on what is left. open_[r]: sequences with room r, as (how many, lengths).
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    rooms = np.zeros(capacity + 1, np.int64)
    for n in np.flatnonzero(left)[::-1].tolist():
        k = int(left[n])
        while k:
            able = np.flatnonzero(rooms[n:])
            if len(able):
                r = n + int(able[0])
                m, held = open_[r].pop()
                each = min(r // n, -(-k // m)) if r // n else 1
                take = min(m, k // each) if each else 0
                if take == 0:
                    each, take = 1, min(m, k)
                if m > take:
                    open_[r].append((m - take, held))
                rooms[r] -= take
                used = each * take
                rest = r - each * n
                held = [*held, *[n] * each]
            else:
                each = min(capacity // n, k)
                take = k // each
                used, rest, held = each * take, capacity - each * n, [n] * each
            k -= used
            if rest:
                open_.setdefault(rest, []).append((take, held))
                rooms[rest] += take
            else:
                out.append((take, held))
    return out + [x for group in open_.values() for x in group], fixed


def places(packed: list[tuple[int, list[int]]], fixed: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: intervals of ranks as arrays (first rank, first sequence, pieces of this length in each sequence, offset of the first of them, whether the reduction fixed them)."""
    found: dict[int, list[tuple[int, int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for i, (many, held) in enumerate(packed):
        at = 0
        for n in dict.fromkeys(held):
            each = held.count(n)
            found.setdefault(n, []).append((rank.get(n, 0), sequence, each, at, i < fixed))
            rank[n] = rank.get(n, 0) + many * each
            at += each * n
        sequence += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


# ---------------------------------------------------------------- rows


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and (task, place) that number the pieces of a length within the task that read them."""
    from pyspark import TaskContext

    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = word_bpe(vocabulary), TaskContext.get().partitionId(), {}
        end = np.uint32(END).astype("<u4").tobytes()
        for b in blocks(batches, 1 << 20):
            row, piece, start, length, crc, place = [], [], [], [], [], []
            for i, data in enumerate(own.encode_many(texts(b.column(1)))):
                data += end
                for k, lo in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[lo : lo + 4 * capacity]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    place.append(seen.get(n, 0))
                    seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(place, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, place long")


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and `fixed`, whether the reduction gave it its place.

    A document's tokens, then END; only documents longer than `capacity` are cut.
    A null or empty text is the end token alone. Repeated rows are packed each;
    a null id stays null. An empty table gives no piece. Pieces are written once
    and read back, so that every task sees the same numbering.
    """
    spark = documents.sparkSession
    cut = saved(pieces(documents, vocabulary, capacity, id_column, text_column), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver, whatever the input.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(*plan(counts, capacity))
    # (length, task) pairs: as many rows for a length as tasks read the input.
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    shared = spark.sparkContext.broadcast(where)  # a few arrays for each of at most `capacity` lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset, fixed = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64), np.empty(len(rank), bool)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges):
                if not len(rows):
                    continue
                n = int(length[rows[0]])
                first, start, each, at, by_rule = plan_of[n]
                i = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[i]
                sequence[rows] = start[i] + inside // each[i]
                offset[rows] = at[i] + inside % each[i] * n
                fixed[rows] = by_rule[i] == 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), pa.array(fixed)], names=[id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fixed"])

    kind = ranked.schema["id"].dataType.simpleString()
    return mapped(ranked, run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fixed boolean")
