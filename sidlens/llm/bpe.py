"""Byte-level BPE: each step takes the root of a segment tree over adjacent pair ranks.

Words of one length class are merged together: their trees are the rows of one
array, so that a step of all words is a few array operations. Very long words
have a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, kept, mapped, texts

#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for text of ASCII, Latin and Greek letters without fractions and the like, where `re` knows the classes, and what shows other text.
SIMPLE = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
NOT_SIMPLE = re.compile("[^\\x20-\\x7E\n\t\r\\u00C0-\\u0233]")
#: Widest word for the joint trees; longer ones are merged one by one.
WIDEST = 64
#: Words a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
_NONE = np.int64(1) << 62


def byte_names() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class ByteBPE:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file: no normalizer, added tokens found first, then words, then merges."""

    def __init__(self, path: str):
        d = json.load(open(path, encoding="utf-8"))
        vocab, names = d["model"]["vocab"], byte_names()
        value = {c: b for b, c in enumerate(names)}
        self.bytes_of = {i: bytes(value[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.byte_id = np.array([vocab[c] for c in names], np.int64)
        self.base = max(vocab.values()) + 1
        left, right, into = (np.empty(len(d["model"]["merges"]), np.int64) for _ in range(3))
        for k, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left[k], right[k], into[k] = vocab[a], vocab[b], vocab[a + b]
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or _NONE."""
        key = a * self.base + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], _NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            width = 2
            while width < len(w):
                width *= 2
            classes.setdefault(width, []).append(i)
        for width, where in classes.items():
            if width > WIDEST:
                for i in where:
                    out[i] = self._long(words[i])
            else:
                for lo in range(0, len(where), 5000):
                    part = where[lo : lo + 5000]
                    for i, ids in zip(part, self._joint([words[i] for i in part], width), strict=True):
                        out[i] = ids
        return out

    def _joint(self, words: list[bytes], width: int) -> list[list[int]]:
        """All words, at most `width` bytes each, by one array of trees: node 1 is the root, leaf p is node width + p.

        A node holds rank * width + p of the least pair below it, so the root
        is the lowest rank's leftmost pair.
        """
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.array([len(w) for w in words])
        at = np.arange(width)
        inside = at[None, :] < length[:, None]
        sym = np.where(inside, self.byte_id[flat], -1)
        nxt = np.where(at[None, :] + 1 < length[:, None], at[None, :] + 1, -1).astype(np.int64)
        prv = np.broadcast_to(at - 1, (n, width)).astype(np.int64).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        r = self.rank(sym[:, :-1], sym[:, 1:])
        tree[:, width : 2 * width - 1] = np.where((r < _NONE) & inside[:, 1:], r * width + at[:-1], _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            p = root % width
            q = nxt[live, p]
            sym[live, p] = self.into[root // width]
            sym[live, q] = -1
            far = nxt[live, q]
            nxt[live, p] = far
            has = far >= 0
            prv[live[has], far[has]] = p[has]
            before = prv[live, p]
            self._put(tree, live, q, np.full(len(live), _NONE), width)
            s = sym[live, p]
            r = self.rank(s, np.where(has, sym[live, far], -2))
            self._put(tree, live, p, np.where(has & (r < _NONE), r * width + p, _NONE), width)
            had = before >= 0
            w, b = live[had], before[had]
            r = self.rank(sym[w, b], s[had])
            self._put(tree, w, b, np.where(r < _NONE, r * width + b, _NONE), width)
            live = live[tree[live, 1] < _NONE]
        kept = sym >= 0
        ids, ends = sym[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        """Sets one leaf of each row's tree and the minima above it."""
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2

    def _long(self, word: bytes) -> list[int]:
        """One word of any length, in n log n."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)]
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        leaves = np.full(2 * width, _NONE, np.int64)
        r = self.rank(sym[:-1], sym[1:])
        leaves[width : width + n - 1] = np.where(r < _NONE, r * width + np.arange(n - 1), _NONE)
        level = width
        while level > 1:
            half = level // 2
            leaves[half:level] = np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2])
            level = half
        tree, sym, into, none = leaves.tolist(), sym.tolist(), self.into, int(_NONE)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            found = pairs.get((a, b))
            if found is None:
                found = pairs[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return found

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while (root := tree[1]) < none:
            p = root % width
            q = nxt[p]
            sym[p], sym[q] = int(into[root // width]), -1
            far = nxt[p] = nxt[q]
            put(q, none)
            if far >= 0:
                prv[far] = p
                put(p, r * width + p if (r := pair(sym[p], sym[far])) < none else none)
            else:
                put(p, none)
            if (b := prv[p]) >= 0:
                put(b, r * width + b if (r := pair(sym[b], sym[p])) < none else none)
        return [s for s in sym if s >= 0]

    def learn(self, words: set[str]) -> None:
        """Remembers of each word its ids in decimal, and the bytes they decode to."""
        order, data, name = list(words), self.bytes_of.__getitem__, self.name_of.__getitem__
        for w, ids in zip(order, self.merge([w.encode("utf-8", "surrogatepass") for w in order]), strict=True):
            self.known[w] = ",".join(map(name, ids))
            self.decoded[w] = b"".join(map(data, ids))

    def pieces(self, text: str) -> list[str]:
        return (PATTERN if NOT_SIMPLE.search(text) else SIMPLE).findall(text)

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at added tokens: (is one, string)."""
        if not any(x in text for x in self.special):
            return [(False, text)] if text else []
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [(False, text[at : m.start()])] * (m.start() > at) + [(True, m[0])]
            at = m.end()
        return out + [(False, text[at:])] * (at < len(text))

    def encode_many(self, batch: list[str]) -> list[tuple[str, int, bytes]]:
        """(decimal ids joined by commas, how many, bytes decoded from the ids) of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.decoded.clear()
        cut = []
        for text in batch:
            words: list[str] = []
            for special, part in self.parts(text):
                if special:
                    words.append(part)
                    self.known[part], self.decoded[part] = str(self.special[part]), self.bytes_of[self.special[part]]
                else:
                    words += self.pieces(part)
            cut.append(words)
        new = set().union(*cut).difference(self.known)
        self.learn(new)
        ids, data = self.known.__getitem__, self.decoded.__getitem__
        out = []
        for words in cut:
            joined = ",".join(map(ids, words))
            out.append((joined, joined.count(",") + bool(joined), b"".join(map(data, words))))
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w], self.decoded[w]
        return out

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_many([text or ""])[0][0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; ids without a token are left out."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


@kept
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id and `ids`, the array of token ids. Null and empty texts have none; repeated rows are encoded each."""
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(vocabulary)
        for b in blocks(batches):
            ids = [[int(x) for x in joined.split(",")] if joined else [] for joined, _, _ in own.encode_many(texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return mapped(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: its id and the text of its ids; null ids give an empty text."""
    rows = encoded.select(encoded[id_column].alias("id"), encoded[ids_column].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return mapped(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(vocabulary)
        for b in blocks(batches):
            done = own.encode_many(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([n for _, n, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in done]),
                    pa.array([hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest() for _, _, data in done]),
                ],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return mapped(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
