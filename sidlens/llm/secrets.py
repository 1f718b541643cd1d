"""Secret scans: fixed patterns, and runs whose characters per token are too few to be language."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, kept, mapped, texts

#: The patterns of the base scan, in the order of their kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Least length: of group 2 of an assignment, of an access key, of a run of hex digits.
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Runs of printable ASCII, in which keys are looked for; shorter ones than LEAST_RANDOM are not weighed, nor are runs without both letters and digits that are shorter than LEAST_PLAIN.
LEAST_RANDOM, LEAST_PLAIN = 16, 20
RUN = re.compile(r"[!-~]{%d,}" % LEAST_RANDOM)
#: The shapes that are weighed: characters of keys and of encoded bytes (a dot ends them, for it also ends sentences), parts of such characters joined by dots, and letters and digits with the signs of passwords.
KEY = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RANDOM)
DOTTED = re.compile(r"[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})+")
SIGNED = re.compile(r"[A-Za-z0-9!@#$%^&*]{20,}")
SIGNS = re.compile(r"[!@#$%^&*]")
#: Characters per token under which a run is random. English prose has above 4, base64 of random bytes about 1.4, hex digits about 1.7.
MOST_RATIO = 2.2
#: The same for runs with signs, which are tokens of their own.
MOST_SIGNED = 1.8

#: Shapes of known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and of identifiers.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIERS = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[A-Za-z]{0,8}[0-9_=+/-]+"),  # numbers, dates, rulers, also after a short name
)
#: snake_case, kebab-case, paths of words; a part of LEAST_PART letters or more must itself tokenize as language does.
JOINED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+")
LEAST_PART = 8
#: Parts of one length that may be the groups of a key.
LEAST_GROUPS = 4
#: Rulers: one to four characters again and again.
RULER = re.compile(r"([^0-9]{1,4}?)\1{4,}[^0-9]{0,3}")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@kept
def encoding(path: str):
    import tiktoken

    ranks = {}
    for line in open(path, "rb"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ratio(run: str, vocabulary: str) -> float:
    return len(run) / len(encoding(vocabulary).encode_ordinary(run))


def is_random(run: str, vocabulary: str) -> bool:
    """Whether a run of key characters tokenizes too badly for language and isn't a known digest or identifier."""
    mixed = re.search("[0-9]", run) and re.search("[A-Za-z]", run)
    if len(run) < (LEAST_RANDOM if mixed else LEAST_PLAIN) or (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)) or any(p.fullmatch(run) for p in (*IDENTIFIERS, RULER)):
        return False
    words = run if re.search("[0-9]", run) else run.strip("_/=+-")
    if JOINED.fullmatch(words) and not is_grouped(words, vocabulary) and all(ratio(x, vocabulary) >= MOST_RATIO for x in re.findall("[A-Za-z]{%d,}" % LEAST_PART, run)):
        return False
    return ratio(run, vocabulary) < MOST_RATIO


def is_grouped(words: str, vocabulary: str) -> bool:
    """Whether joined parts are the groups of a key: LEAST_GROUPS or more of one length, 4 to 7, that together tokenize worse than words do."""
    parts = re.findall("[A-Za-z0-9]+", words)
    if len(parts) < LEAST_GROUPS or len({len(p) for p in parts}) > 1 or not 4 <= len(parts[0]) < LEAST_PART or not any(p.isalpha() for p in parts):
        return False
    return sum(map(len, parts)) < MOST_RATIO * sum(len(encoding(vocabulary).encode_ordinary(p)) for p in parts)


def is_signed(run: str, vocabulary: str) -> bool:
    """Whether a run of letters of both cases, digits and signs holds no part that reads as a word and tokenizes too badly."""
    if not all(re.search(p, run) for p in ("[a-z]", "[A-Z]", "[0-9]", SIGNS)):
        return False
    if any(ratio(x, vocabulary) >= MOST_RATIO for x in re.findall("[A-Za-z]{5,}", run)):
        return False
    return ratio(run, vocabulary) < MOST_SIGNED


def random_spans(run: str, vocabulary: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what is random in a run of printable characters: dotted and signed shapes as wholes, else runs of key characters."""
    at = 0
    wholes = [*((m, is_random) for m in DOTTED.finditer(run)), *((m, is_signed) for m in SIGNED.finditer(run) if SIGNS.search(m[0]))]
    for m, test in sorted(wholes, key=lambda x: x[0].start()):
        if m.start() >= at and test(m[0], vocabulary):
            yield from keys_between(run, at, m.start(), vocabulary)
            yield m.span()
            at = m.end()
    yield from keys_between(run, at, len(run), vocabulary)


def keys_between(run: str, lo: int, hi: int, vocabulary: str) -> Iterator[tuple[int, int]]:
    for m in KEY.finditer(run, lo, hi):
        if is_random(m[0], vocabulary):
            yield m.span()


def find(text: str, vocabulary: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of each span, in order; code points, end exclusive."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    out.sort()
    base, covered = iter(united(out)), (0, 0)
    random = []

    def weigh(lo: int, hi: int) -> None:
        if hi - lo >= LEAST_RANDOM:
            random.extend((lo + i, 3, lo + j) for i, j in random_spans(text[lo:hi], vocabulary))

    for m in RUN.finditer(text):
        at, end = m.span()
        # What base spans leave of the run is weighed by itself.
        while covered is not None and at < end:
            if covered[1] <= at:
                covered = next(base, None)
                continue
            weigh(at, min(end, max(at, covered[0])))
            if covered[0] >= end:
                at = end
                break
            at = covered[1]
        weigh(at, end)
    return sorted(out + random)


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of sorted spans (start, kind, end), overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: Of maximal runs only long ones count, so those are searched for.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)


def spans_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id and `found`, an array of (kind, start, end) by start, then kind.

    The base kinds are assign, access and hex. `random` adds what is weighed
    outside base spans and has too few characters per token: runs of
    [A-Za-z0-9+/_=-], 16 or more with both letters and digits, else 20 or more; parts
    of eight or more of [A-Za-z0-9_-] joined by dots; 20 or more letters and digits
    with some of !@#$%^&*; four or more groups of one length, 4 to 7. Known
    digests, identifiers, words joined by signs and rulers are left out. Null and empty texts have no span. Repeated rows are scanned
    each; other columns are ignored. Positions are code points, end exclusive.
    """
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, vocabulary)] for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], names=[id_column, "found"])

    return mapped(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long>>")


def redact(text: str, vocabulary: str, mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for s, _, e in find(text, vocabulary):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redacted(documents: DataFrame, vocabulary: str, text_column: str = "text", count_column: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with secrets in the text replaced; null stays null. `count_column`, if present, follows the new length."""
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, column=text_column):
            i = b.schema.get_field_index(text_column)
            new = [x if x is None else redact(x, vocabulary) for x in b.column(i).to_pylist()]
            columns = [pa.array(new, b.schema.field(i).type) if j == i else c for j, c in enumerate(b.columns)]
            if count_column and (k := b.schema.get_field_index(count_column)) >= 0:
                columns[k] = pa.array([None if x is None else len(x) for x in new]).cast(b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return mapped(documents, run, schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
