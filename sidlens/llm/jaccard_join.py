"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Two sets of similarity t or more differ in at most (s1 + s2)(1 - t)/(1 + t)
elements. Hash the universe into segments: if each segment is given a tolerance
(0: equal, 1: equal up to one element) and tolerances plus one sum to more than
that bound, some segment of the two agrees within its tolerance. Sets are
indexed under their segment subsets and, where the tolerance is 1, under the
subsets less one element. The number of segments depends on a band of sizes, and
how many have tolerance 1 on what it costs.

Empty subsets agree whatever the sets, so there are some more segments than the
bound asks for: if a set has so few (nearly) empty segments that the others still
sum to more than the bound, then a segment that isn't empty must agree, and the
set's empty subsets aren't indexed. If either set of a pair is like that, the
pair meets in such a segment; else both have all their subsets in the index.

Members of a shared index entry are compared by parity bitmaps of one to two
bits an element, whose difference never exceeds that of the sets, and what passes
is verified on the sets. An element is the 64-bit hash of a shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, dropped, mapped, mix, saved, shingles, text_bytes, unused

_U = np.uint64
#: Bits of the smallest parity bitmap; larger sets have at least one bit an element, always a power of 2.
BITS = 1024
#: Members of an index entry that one task compares with each other; larger entries are cut into blocks, and each pair of blocks is a task's.
CELL = 512
#: Members of an index entry beyond which it isn't looked up whether other entries have the same members.
SAME = 1 << 18
#: Sets of a component that one task compares with each other for links, as CELL for entries; they carry their elements.
LINKED = 256
#: Distinct texts that a task remembers to have indexed; copies of them are not indexed again.
REMEMBERED = 1 << 20
#: Cost of comparing a pair that shares an entry by chance, in index entries: bitmaps of two members take about 0.2 microseconds, an entry that is written, dealt out and sorted about 2.
PAIR_COST = 0.1
#: Weight to spare for empty segments, beyond the mean in standard deviations, and the share of sets that index all nevertheless; first none to spare.
SPARE = ((0, 1.0), (0, 0.5), (1, 0.16), (3, 0.0014))
#: Share of pairs of unrelated sets that are taken to have a passage in common, for the costs.
COMMON = 0.1


# ---------------------------------------------------------------- sizes and segments


class Bands:
    """Bands of set sizes such that linked sets lie in one band or in neighbours, and each band's scheme of segments."""

    def __init__(self, num: int, den: int, sizes: dict[int, int]):
        """num/den: the least similarity. sizes: how many sets have sizes between each power of 2 and the next."""
        self.num, self.den = num, den
        largest = 2 << max(sizes, default=0)
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, edges[-1] * den // num + 1))
        self.edges = np.array([*edges, edges[-1] * den // num + 1])
        self.schemes = [self._scheme(j, sizes) for j in range(len(edges))]
        self.segments = np.array([p + q for p, q, _ in self.schemes])
        self.loose = np.array([q for _, q, _ in self.schemes])
        self.spare = np.array([x for _, _, x in self.schemes])

    def differ(self, total):
        """The most elements in which two sets of this many elements together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def _scheme(self, j: int, sizes: dict[int, int]) -> tuple[int, int, int]:
        """(segments of tolerance 0, segments of tolerance 1, weight to spare for empty ones) for sets of band j against bands j and j + 1, of least cost."""
        top = int(self.edges[j + 1]) - 1
        need = int(self.differ(top + top * self.den // self.num)) + 1
        size = int(self.edges[j])
        n = float(sizes.get(size.bit_length() - 1, 0)) + 1
        best = None
        for q in sorted({need * k // 16 for k in range(9)}):
            for sigmas, unsure in SPARE:
                p = max(0, need - 2 * q)
                for _ in range(8):
                    mean = size / (p + q)
                    empty = math.exp(-mean) * (p + 2 * q * (1 + mean))
                    p = max(0, need - 2 * q + math.ceil(empty + sigmas * math.sqrt(empty)) * (unsure < 1))
                mean = size / (p + q)
                # Sets that index all agree in empty segments. Those with a passage in common agree where its elements are the only ones of their segment, or all but one.
                chance = (unsure**2 + COMMON) * math.exp(-2 * mean) * (p + q * (1 + mean) ** 2)
                cost = n * (p + q * (1 + mean)) + PAIR_COST * n * n / 2 * min(1.0, chance)
                if best is None or cost < best[0]:
                    best = (cost, p, q, p + 2 * q - need)
        return best[1:]

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, "right") - 1


def entries(sets: list[np.ndarray], bands: Bands) -> list[np.ndarray]:
    """Each set's index entries: of its own band's scheme, and of the scheme of the band below."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, _U), *sets])
    code = mix(flat ^ _U(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(len(sets)), sizes)
    keys, owners = [], []
    for below in (0, 1):
        j = bands.band(np.maximum(sizes, 1)) - below
        used = (j >= 0) & (sizes > 0)
        m = np.where(used, bands.segments[np.maximum(j, 0)], 0)
        first = np.cumsum(m) - m
        mine = used[owner]
        o, h, c = owner[mine], flat[mine], code[mine]
        segment = (h % m[o].astype(_U)).astype(np.int64)
        where = first[o] + segment
        total = np.zeros(int(m.sum()), _U)
        np.add.at(total, where, c)
        held = np.bincount(where, minlength=len(total))
        set_of = np.repeat(np.arange(len(sets)), m)
        number = np.arange(len(total)) - first[set_of]
        loose = number < bands.loose[j[set_of]]
        # What of the weights lies on segments whose agreement says nothing; all subsets are indexed if that may be all.
        weight = np.bincount(set_of, (held == 0) * 1 + loose * (2 * (held <= 1) - (held == 0)), len(sets))
        sparing = weight <= bands.spare[np.maximum(j, 0)]
        tag = lambda s, i: i.astype(_U) * _U(0x9E3779B97F4A7C15) + j[s].astype(_U) * _U(0xD1B54A32D192ED03)  # noqa: E731, B023
        full = (held > 0) | ~sparing[set_of]
        keys.append(mix(total[full] + tag(set_of[full], number[full])))
        owners.append(set_of[full])
        less = (segment < bands.loose[j[o]]) & ((held[where] > 1) | ~sparing[o])
        if less.any():
            o, segment, c, where = o[less], segment[less], c[less], where[less]
            keys.append(mix(total[where] - c + tag(o, segment)))
            owners.append(o)
    key, who = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.split(key[order], np.cumsum(np.bincount(who, minlength=len(sets)))[:-1])


def bits_of(sizes: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets of these sizes."""
    return np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """The parity of how many elements of each set fall on each of its bits. Folding a bitmap in two gives that of half the bits."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = bits_of(sizes)
    ends = np.cumsum(bits)
    place = (np.concatenate([np.zeros(0, _U), *sets]) >> _U(40)).astype(np.int64)
    at = np.repeat(ends - bits, sizes) + (place & np.repeat(bits - 1, sizes))
    raw = np.packbits(np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1).tobytes()
    return [raw[a:z] for a, z in zip(((ends - bits) // 8).tolist(), (ends // 8).tolist(), strict=True)]


def name(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set; the first 8 also serve alone, as a number."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# ---------------------------------------------------------------- cells


class Cell:
    """Members of one index entry, or of two blocks of it, in order of their names."""

    def __init__(self, names: list[bytes], sizes: np.ndarray, maps: list[bytes], side: np.ndarray, bands: Bands, across: bool):
        self.names, self.sizes, self.maps, self.side, self.bands, self.across = names, sizes, maps, side, bands, across
        self.width = np.array([len(m) for m in maps])
        self.folded: dict[int, np.ndarray] = {}

    def at_width(self, width: int) -> np.ndarray:
        """Row i: the bitmap of member i folded to `width` bytes, zeros if it is narrower."""
        if width not in self.folded:
            out = np.zeros((len(self.maps), width // 8), np.uint64)
            for w in np.unique(self.width[self.width >= width]).tolist():
                rows = np.flatnonzero(self.width == w)
                m = np.frombuffer(b"".join(self.maps[i] for i in rows), np.uint64).reshape(len(rows), -1, width // 8)
                out[rows] = np.bitwise_xor.reduce(m, 1)
            self.folded[width] = out
        return self.folded[width]

    def passing(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of other members, those whose sizes and bitmaps allow a link with member i."""
        n, s = int(self.sizes[i]), self.sizes[others]
        ok = np.minimum(s, n) * self.bands.den >= np.maximum(s, n) * self.bands.num
        if self.across:
            ok &= self.side[others] != self.side[i]
        others = others[ok]
        common = np.minimum(self.width[others], self.width[i])
        fits = np.zeros(len(others), bool)
        for w in np.unique(common).tolist():
            mine, at = self.at_width(w), np.flatnonzero(common == w)
            fits[at] = np.bitwise_count(mine[others[at]] ^ mine[i]).sum(1) <= self.bands.differ(self.sizes[others[at]] + n)
        return others[fits]

    def forest(self) -> list[tuple[bytes, bytes]]:
        """Pairs that span each connected part of what passes: fewer than members."""
        out, left = [], np.arange(len(self.names))
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                found = self.passing(i, left)
                if len(found):
                    out += [(self.names[i], self.names[k]) for k in found.tolist()]
                    left = left[~np.isin(left, found, assume_unique=True)]
                    queue += found.tolist()
        return out

    def pairs(self, roots: list[bytes]) -> list[tuple[bytes, bytes]]:
        """All that passes between members of different roots."""
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        root, out = np.array([number[r] for r in roots]), []
        for i in range(len(self.names) - 1):
            others = np.arange(i + 1, len(self.names))
            out += [(self.names[i], self.names[k]) for k in self.passing(i, others[root[others] != root[i]]).tolist()]
        return out


def _cells(members: DataFrame, cell: int, *columns: str, across: bool = True) -> DataFrame:
    """Members (entry, fp, ...) dealt to cells (entry, i, j): a large entry is cut into blocks, and each pair of blocks is a cell; or, if not `across`, each block alone."""
    size = members.groupBy("entry").agg(F.count("*").alias("c")).where(F.col("c") > cell)
    n_blocks = F.coalesce(F.ceil(F.col("c") / cell), F.lit(1)).cast("int")
    rows = members.join(size, "entry", "left").withColumn("blocks", n_blocks).withColumn("side", F.pmod(F.xxhash64("fp", "entry"), F.col("blocks")).cast("int")).drop("c")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("side"))
    rows = rows.select("entry", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "fp", "n", "map", "side", *columns)
    return rows.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j", "fp")


def _cell(t: pa.Table, bands: Bands) -> Cell:
    return Cell(t["fp"].to_pylist(), t["n"].to_numpy(), t["map"].to_pylist(), t["side"].to_numpy(), bands, t["i"][0].as_py() != t["j"][0].as_py())


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets link."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def cell_links(sets: DataFrame, bands: Bands, counted: bool) -> DataFrame:
    """All links (a, b) between sets (entry, fp, n, map, size, elements) of one component each; or counted, per cell and set (fp, n): of how many rows the sets are that it links to."""
    dealt = _cells(sets, LINKED, "size", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> list[tuple[int, int]]:
            cell = _cell(t, bands)
            own = [np.frombuffer(x, _U) for x in t["elements"].to_pylist()]
            return [(i, k) for i in range(len(own) - 1) for k in cell.passing(i, np.arange(i + 1, len(own))).tolist() if alike(own[i], own[k], bands.num, bands.den)]

        held: list[pa.Table] = []
        for found in grouped(batches, ["entry", "i", "j"], held):
            for t in found:
                pairs, names, size = solve(t), t["fp"].to_pylist(), t["size"].to_numpy()
                if not pairs:
                    continue
                if counted:
                    n = np.zeros(len(names), np.int64)
                    for i, k in pairs:
                        n[i] += size[k]
                        n[k] += size[i]
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.binary()), pa.array(n[at])], names=["fp", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.binary()), pa.array([names[k] for _, k in pairs], pa.binary())], names=["a", "b"])

    return mapped(dealt, run, "fp binary, n long" if counted else "a binary, b binary")


def cell_pairs(members: DataFrame, bands: Bands, rooted: bool) -> DataFrame:
    """Candidate pairs (entry, a, b) of members (entry, fp, n, map[, root]): spanning ones of each block, or with roots all between different roots."""
    dealt = _cells(members, CELL, *(["root"] if rooted else []), across=rooted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for found in grouped(batches, ["entry", "i", "j"], held):
            entry, out = [], []
            for t in found:
                cell = _cell(t, bands)
                pairs = cell.pairs(t["root"].to_pylist()) if rooted else cell.forest()
                out += pairs
                entry += [t["entry"][0].as_py()] * len(pairs)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), pa.array([min(p) for p in out], pa.binary()), pa.array([max(p) for p in out], pa.binary())], names=["entry", "a", "b"])

    return mapped(dealt, run, "entry long, a binary, b binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], held: list[pa.Table]) -> Iterator[list[pa.Table]]:
    """Sorted rows as tables of one key each, a list of them for each batch."""
    for b in batches:
        t = pa.concat_tables([*held, pa.Table.from_batches([b])]).combine_chunks()
        held.clear()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t[k].to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        held.append(t.slice(cuts[-1]))
        yield [t.slice(a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z - a > 1]
    if held:
        yield [t for t in held if t.num_rows > 1]
        held.clear()


# ---------------------------------------------------------------- the join


def similar_components(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", count_links: bool = False) -> DataFrame:
    """Per row: its id, n_shingles and component_id, the least id reachable by links; with count_links also n_links, the number of other rows that it links to.

    Two rows link when den * |intersection| >= num * |union| of their distinct
    `words`-word shingles; with fewer words, all of them are one shingle. Null and
    empty texts, and those of white space, have no shingle and no link. Repeated
    rows link with each other. A null id is no component's least unless it
    stands alone, then component_id is null. Other columns are ignored.
    """
    index, nodes, roots, links = _join(documents, words, num, den, id_column, text_column)
    known = nodes.select("fp", "id", "size").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = known.join(least, "root").select("fp", "component_id", "size")
    if count_links:
        of_set = of_set.join(links(True).groupBy("fp").agg(F.sum("n").alias("others")), "fp", "left")
    out = index.select("id", "n", "fp").join(of_set, "fp", "left")
    n_links = [F.coalesce(F.col("size") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links")] if count_links else []
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *n_links)


def similar_pairs(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All links between different sets: (id_a, rows_a, id_b, rows_b). Rows of equal sets are one class, named by its least id, with its number of rows; they all link with each other. id_a is the lesser."""
    _, nodes, _, links = _join(documents, words, num, den, id_column, text_column)
    named = lambda x: nodes.select(F.col("fp").alias(x), F.struct("id", "size").alias(f"s{x}"))
    r = links(False).join(named("a"), "a").join(named("b"), "b")
    r = r.select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb"))
    return r.select(F.col("sa.id").alias("id_a"), F.col("sa.size").alias("rows_a"), F.col("sb.id").alias("id_b"), F.col("sb.size").alias("rows_b"))


def _join(documents: DataFrame, words: int, num: int, den: int, id_column: str, text_column: str):
    """(rows with their set's name, distinct sets, roots of those that link, and a function that gives all links or their number per set)."""
    text = F.coalesce(documents[text_column], F.lit(""))
    rows = documents.select(documents[id_column].alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()

    # How many texts there are of about each size: 64 numbers, for the costs; and a bound of the largest set.
    size = F.octet_length("text")
    counted = rows.groupBy(F.floor(F.log2(size / 6 + 1)).cast("int").alias("k")).agg(F.count("*").alias("n"), F.max(size).alias("m")).collect()
    by_size = {r["k"]: r["n"] for r in counted}
    by_size.setdefault((max((r["m"] for r in counted), default=0) // 2 + 1).bit_length(), 0)
    bands = Bands(num, den, by_size)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for b in blocks(batches, 1 << 19):
            sets = shingles(*text_bytes(b.column(1)), words)
            names = [name(s) if len(s) else None for s in sets]
            if len(known) > REMEMBERED:
                known.clear()
            new = [x is not None and x not in known and not known.add(x) for x in names]
            own = iter(entries([s for s, k in zip(sets, new, strict=True) if k], bands))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array([None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in names], pa.int64()),
                    pa.array(bitmaps(sets), pa.binary()),
                    pa.array([next(own).view(np.int64) if k else None for k in new], pa.list_(pa.int64())),
                ],
                names=["id", "hash", "n", "fp", "lo", "map", "entries"],
            )

    index = saved(mapped(rows, indexed, f"id {kind}, hash long, n long, fp binary, lo long, map binary, entries array<long>"), "index")
    shared = index.select(F.explode("entries").alias("entry"), "lo").repartition("entry").sortWithinPartitions("entry", "lo")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of entries that several sets share. An entry is renamed after its members, so that equal ones fall together."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found(entry, lo):
            new = np.ones(len(entry), bool)
            new[1:] = (entry[1:] != entry[:-1]) | (lo[1:] != lo[:-1])
            entry, lo = entry[new], lo[new]
            start = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
            count = np.diff(np.append(start, len(entry)))
            members = np.add.reduceat(mix(lo.view(_U)), start)
            key = np.where(count < SAME, mix(members + count.astype(_U)), mix(entry[start].view(_U)))
            kept = np.repeat(count > 1, count)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(key, count)[kept].view(np.int64)), pa.array(lo[kept])], names=["entry", "lo"])

        for b in batches:
            entry, lo = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = int(np.searchsorted(entry, entry[-1], "left")) if len(entry) else 0
            if held and len(entry) and (cut or entry[0] != held[-1][0][-1]):
                # What was held ends here, or before.
                yield found(*(np.concatenate(x) for x in zip(*held, (entry[:cut], lo[:cut]), strict=True)))
                held = []
            elif cut:
                yield found(entry[:cut], lo[:cut])
            held.append((entry[cut:], lo[cut:]))
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    members = mapped(shared, together, "entry long, lo long").distinct()
    one = [F.first(c).alias(c) for c in ("lo", "n", "map", "hash")]
    nodes = saved(index.where(F.col("fp").isNotNull()).groupBy("fp").agg(*one, F.first("id").alias("of"), F.min("id").alias("id"), F.count("*").alias("size")), "sets")
    members = saved(members.join(nodes.select("lo", "fp", "n", "map"), "lo").drop("lo"), "members")
    slim = saved(index.select("id", "n", "fp"), "index")
    dropped(index)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 20):
            sets = shingles(*text_bytes(b.column(1)), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "elements"])

    def elements_of(pairs: DataFrame) -> DataFrame:
        """(fp, elements) of the sets that pairs name, each from one text; those that surely aren't named are left out before the join."""
        from .suffix_dedup import _filter, _in_filter

        named = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        wanted = saved(named.join(nodes.select("fp", F.col("of"), F.col("hash").alias("lo")), "fp"), "wanted")
        bits = rows.sparkSession.sparkContext.broadcast(_filter(wanted))  # of fixed size

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(_in_filter(bits.value, b.column(2).to_pylist())))

        near = mapped(rows, possible, f"id {kind}, text string, hash long")
        texts_of = wanted.join(near, (F.col("lo") == F.col("hash")) & F.col("of").eqNullSafe(F.col("id"))).select("fp", "text")
        out = saved(mapped(texts_of, rebuilt, "fp binary, elements binary").dropDuplicates(["fp"]), "elements")
        dropped(wanted)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs, "pairs")
        sets = elements_of(pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    ok.append(alike(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), num, den))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

        full = pairs.join(sets.select(F.col("fp").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("elements").alias("y")), "b")
        out = saved(mapped(full.select("a", "b", "x", "y"), run, "a binary, b binary, linked boolean"), "verified")
        dropped(pairs, sets)
        return out

    # First what spans the members of each block that may link, then all that may still join different components:
    # of entries of several blocks, or where what spans doesn't link after all.
    spanning = saved(cell_pairs(members, bands, rooted=False), "spanning")
    tried = verified(spanning.select("a", "b").distinct())
    links = tried.where("linked").select("a", "b")
    roots = saved(components(links), "roots")
    failed = spanning.join(tried.where("NOT linked").select("a", "b"), ["a", "b"], "left_semi").select("entry")
    several = members.groupBy("entry").agg(F.count("*").alias("c")).where(F.col("c") > CELL).select("entry")
    rooted = members.join(failed.union(several).distinct(), "entry", "left_semi").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(rooted, "rooted")
    differing = rooted.groupBy("entry").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y")).select("entry")
    rest = cell_pairs(rooted.join(differing, "entry", "left_semi"), bands, rooted=True).select("a", "b").distinct()
    more = verified(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    dropped(roots)
    links = saved(links.union(more.where("linked").select("a", "b")), "links")
    dropped(members, spanning, tried, rooted, more)
    roots = saved(components(links), "roots")
    dropped(links)

    def all_links(counted: bool) -> DataFrame:
        """Linked sets lie in one component, so all of a component's sets are compared."""
        sets = elements_of(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        of_root = roots.select(F.col("node").alias("fp"), F.xxhash64("root").alias("entry"))
        out = saved(cell_links(of_root.join(nodes.select("fp", "n", "map", "size"), "fp").join(sets, "fp"), bands, counted), "all-links")
        dropped(sets)
        return out

    return slim, nodes, roots, all_links


def one_of_each(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of the rows that stay: of each component one row, of the least id (a null id only if there is no other); rows without shingles all stay."""
    index, nodes, roots, _ = _join(documents, words, num, den, id_column, text_column)
    own = index.where(F.col("fp").isNotNull()).select("id", "fp").distinct()
    own = own.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("x"))
    fp, own_id, of = (unused(c, documents.columns) for c in ("fp", "id", "of"))
    chosen = saved(chosen.select(F.col("x.id").alias(own_id), F.col("x.fp").alias(of)), "chosen")
    dropped(index, nodes, roots)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 20, text_column):
            sets = shingles(*text_bytes(b.column(b.schema.get_field_index(text_column))), words)
            fps = pa.array([name(x) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, fp])

    rows = mapped(documents, named, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{fp}` binary")
    bare = rows.where(F.col(fp).isNull()).drop(fp)
    # A set is chosen once; of equal rows of that id one stays.
    kept = rows.join(chosen, (F.col(fp) == F.col(of)) & F.col(id_column).eqNullSafe(F.col(own_id))).dropDuplicates([fp])
    return kept.select(*documents.columns).unionByName(bare)
