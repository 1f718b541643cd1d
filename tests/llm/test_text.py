import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from sidlens.llm import bpe, fingerprint, packing, quality, secrets, token_count
from sidlens.llm.queries import QUERIES, vocabulary

ALPHABET = [*map(chr, range(32, 127)), "\n", "\t", "é", "ß", "Σ", "İ", "中", "😀", "́", " ", "\xa0", "\x00", "'s", "'LL", "<|endoftext|>", "  "]


def texts(n=400, longest=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(longest))) for _ in range(n)] + ["", " ", "a" * 3000, "ab " * 500, "the thing " * 50]


def table(spark, rows):
    """With columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, id string")


EDGES = [(1, None), (2, ""), (3, " \n"), (None, "the cat sat on the mat again"), (4, "z" * 20_000), (5, "same same"), (5, "same same")]


def test_byte_bpe_is_the_librarys():
    path = vocabulary("byte_bpe_50k.json")
    own, library = bpe.ByteBPE(path), Tokenizer.from_file(path)
    for t, (ids, n, data) in zip(texts(), own.encode_many(texts()), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert (ids, n) == (",".join(map(str, want)), len(want))
        assert data.decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False) == own.decode(want) == t


def test_unigram_counts_are_the_librarys():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], 0, True))
    own = token_count.UnigramCounter(path)
    for t in texts():
        assert own.count(t) == (len(library.encode(token_count.SPACE + t.replace(" ", token_count.SPACE)).ids) if t else 0)


def test_word_ids_are_the_librarys():
    path = vocabulary("word_bpe_49k.json")
    own, library = packing.WordBPE(path), Tokenizer.from_file(path)
    batch = [*texts(), "ΟΔΟΣ <|startoftext|> Éá"]
    for t, data in zip(batch, own.encode_many(batch), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_fits_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(k) for n, k in zip(rng.integers(1, 101, 40), rng.integers(1, 50, 40), strict=True)}
    plan = packing.plan(counts, 100)
    held = {}
    plan, fixed = plan
    for many, lengths in plan:
        assert sum(lengths) <= 100 and many > 0
        for n in lengths:
            held[n] = held.get(n, 0) + many
    assert held == counts
    used, least = sum(m for m, _ in plan), -(-sum(n * k for n, k in counts.items()) // 100)
    # No sequence holds less than half twice over; and never worse than first fit decreasing's bound.
    assert used <= 11 / 9 * max(least, sum(k for n, k in counts.items() if n > 50)) + 1
    assert packing.plan({}, 100) == ([], 0)


def test_pack_edges(spark):
    r = packing.pack(table(spark, EDGES), vocabulary("word_bpe_49k.json"), 16).collect()
    assert sum(x["length"] for x in r if x["doc_id"] == 1) == 1
    assert len([x for x in r if x["doc_id"] == 5]) == 2
    by = {}
    for x in r:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 16
    assert packing.pack(table(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_secrets():
    v = vocabulary("byte_bpe_50k.tiktoken")
    digest, key = hashlib.sha1(b"x").hexdigest(), "qX7vB2kL9mZ4wR8tY1uP5sD3fG6hJ0aC"
    t = f'é password = "hunter22" token=ab AKIA{"Q" * 16} {digest} {key} 123e4567-e89b-12d3-a456-426614174000 some_long_identifier_name_here'
    found = {secrets.KINDS[k]: t[s:e] for s, k, e in secrets.find(t, v)}
    assert found == {"assign": 'password = "hunter22', "access": "AKIA" + "Q" * 16, "hex": digest, "random": key}
    # What a match that fails has passed isn't searched again.
    assert secrets.find("token=token: abcdefgh", v) == []
    assert secrets.redact(t, v).count("[SECRET]") == 4 and secrets.redact("plain", v) == "plain"
    assert secrets.find("paſſword=abcdefgh", v) == [] and secrets.find("", v) == []


@pytest.mark.parametrize("alphabet", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters])
def test_random_letters_are_secrets(alphabet):
    v, rng = vocabulary("byte_bpe_50k.tiktoken"), random.Random(4)
    keys = ["".join(rng.choices(alphabet, k=n)) for n in (24, 32, 40, 64) for _ in range(25)]
    found = [secrets.redact(f"see {k} here", v) == "see [SECRET] here" for k in keys]
    assert sum(found) >= 0.98 * len(keys)
    assert secrets.is_random("-".join(keys[:2]), v)
    for clean in ("internationalization", "INTERNATIONALIZATION", "getElementsByClassNameOrIdentifier", "some_long_identifier_name_here", "a-b-c-d-e-f-g-h-i-j-k-l-m", "z" * 50, "xy" * 20, "/usr/lib/x/y/z/w/v/u/t/s"):
        assert secrets.find(clean, v) == []


def test_shapes_of_keys_are_secrets():
    v, rng = vocabulary("byte_bpe_50k.tiktoken"), random.Random(6)
    plain = string.ascii_letters + string.digits
    shapes = {
        "sixteen": lambda: "".join(rng.choices(plain, k=16)),
        "dotted": lambda: ".".join("".join(rng.choices(plain, k=14)) for _ in range(3)),
        "signed": lambda: "".join(rng.choices(plain + "!@#$%^&*", k=24)),
        "groups": lambda: "-".join("".join(rng.choices(string.ascii_uppercase, k=5)) for _ in range(5)),
    }
    for name, make in shapes.items():
        keys = [make() for _ in range(300)]
        whole = [any(k == 3 and e - s == len(x) for s, k, e in secrets.find(f"see {x} here.", v)) for x in keys]
        assert np.mean(whole) > 0.9, name
    for clean in ("internationalization-of-the-web", "https://www.example.com/some/path?id=12&x=3", "x=(a[i]+b[j])*c;d=e[0]", "2024-01-01T10:00:00Z", "FIRST-SECOND-THIRD-FOURTH", "PLAIN-WORDS-THESE-READS", "my.very.long.package.name", "ISBN978-3-16-148410-0", "foo@example.com,bar@example.org", "v" * 40, "=" * 30):
        assert secrets.find(clean, v) == [], clean


def test_secret_columns(spark):
    v = vocabulary("byte_bpe_50k.tiktoken")
    assert all(r["found"] == [] for r in secrets.scan_secrets(table(spark, EDGES), v).collect())
    df = table(spark, [(1, "secret: abcdef1"), (2, None)])
    assert [(r["doc_id"], r["text"], r["id"]) for r in secrets.redacted(df, v).orderBy("doc_id").collect()] == [(1, "[SECRET]", "x"), (2, None, "x")]
    assert secrets.scan_secrets(table(spark, []), v).count() == 0


def test_counts_and_round_trip_edges(spark):
    df = table(spark, EDGES)
    counts = {(r["doc_id"], r["n_chars"]): r["n_tokens"] for r in token_count.token_counts(df, vocabulary("piece_bpe_32k.model")).collect()}
    assert counts[1, 0] == 0 and counts[2, 0] == 0 and counts[4, 20_000] > 0 and len(counts) == 6
    r = {x["doc_id"]: x for x in bpe.round_trip(df, vocabulary("byte_bpe_50k.json")).collect()}
    assert r[1]["n_tokens"] == 0 and r[1]["ids_sha256"] == r[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert r[4]["decoded_sha256"] == hashlib.sha256(b"z" * 20_000).hexdigest()
    encoded = bpe.encode_documents(df, vocabulary("byte_bpe_50k.json"))
    assert {x["text"] for x in bpe.decode_documents(encoded, vocabulary("byte_bpe_50k.json")).collect()} == {t or "" for _, t in EDGES}


def exact(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches():
    import pyarrow as pa

    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    a = " ".join(rng.choices(words, k=900))
    b = a[:3000] + " ".join(rng.choices(words, k=400))
    x, y = fingerprint.sketches(pa.array([a, b]))
    assert abs(x.resemblance(y) - jaccard(exact(a), exact(b))) < 0.15
    assert abs(x.containment(y) - len(exact(a) & exact(b)) / len(exact(a))) < 0.2
    assert abs(x.distinct() / len(exact(a)) - 1) < 0.3
    # Parts merge to the sketch of the whole.
    data = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    S = fingerprint.Sketch
    assert np.array_equal(S.of(data[::2]).merge(S.of(data[1::2])).hashes, S.of(data).hashes)
    assert np.array_equal(S.parse(str(x)).hashes, x.hashes)
    empty = S.of(data[:0])
    assert empty.resemblance(empty) == 1 and empty.resemblance(x) == 0 and empty.containment(x) == 1


def test_edited_texts(spark):
    rows = [(3, "one two three four five six"), (1, "alpha beta"), (2, None), (9, "é" * 7)]
    r = {x["doc_id"]: x for x in fingerprint.likeness_to_edited(table(spark, rows).repartition(3)).collect()}
    by = dict(rows)
    order = sorted(by)
    for k, i in enumerate(order):
        t, after = by[i] or "", by[order[(k + 1) % 4]] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r[i]["n_chars"] == len(t) and r[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r[i]["near_edited"] == jaccard(exact(t), exact(new)) and r[i]["near_next"] == jaccard(exact(t), exact(after))
    one = fingerprint.likeness_to_edited(table(spark, [(1, "a b")])).first()
    assert one["near_next"] == 1
    assert len(fingerprint.likeness_to_edited(table(spark, EDGES)).collect()) == len(EDGES)
    assert fingerprint.likeness_to_edited(table(spark, [])).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op9_quality_scores"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.93
    net = quality.fit(["good text"] * 3 + ["!!!! ####"] * 3, [1] * 3 + [0] * 3)
    scored = quality.with_quality(table(spark, EDGES), net).collect()
    assert len(scored) == len(EDGES) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.with_quality(table(spark, []), quality.fit([], [])).count() == 0


def mirrored(n, a, b):
    """A word of two letters in the order of the parity of set bits, which polynomial hashes modulo powers of 2 can't tell from its mirror."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_mirrored_words_differ(n):
    import pyarrow as pa

    from sidlens.llm import common

    a, b, upper = common.shingles(*common.text_bytes(pa.array([mirrored(n, "a", "b"), mirrored(n, "b", "a"), mirrored(n, "A", "B")])), 5)
    assert a[0] == upper[0] != b[0]


def fewest(items, capacity):
    """The least number of sequences, by trying all sets with the longest piece."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for chosen in range(1 << len(rest)):
        held = [x for i, x in enumerate(rest) if chosen >> i & 1]
        if first + sum(held) <= capacity:
            best = min(best, 1 + fewest([x for i, x in enumerate(rest) if not chosen >> i & 1], capacity))
    return best


def test_reduction_keeps_the_optimum():
    rng, some = random.Random(1), 0
    for _ in range(120):
        capacity = rng.randrange(8, 40)
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 8))), reverse=True)
        left = np.bincount(items, minlength=capacity + 1)
        fixed = packing.reduced(left, capacity)
        rest = np.repeat(np.arange(capacity, -1, -1), left[::-1]).tolist()
        some += sum(m * len(h) for m, h in fixed)
        assert sum(m for m, _ in fixed) + fewest(rest, capacity) == fewest(items, capacity)
    assert some > 100


def test_packing_query(spark):
    sf, library = "/root/testdata/sf0.001", Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, sequences = set(), {}
    for i, t in docs.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, lo, len(part := ids[lo : lo + 4096]), zlib.crc32(part.tobytes())) for k, lo in enumerate(range(0, len(ids), 4096))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    least = -(-sum(n for _, _, _, n, _ in want) // 4096)
    assert least <= len(sequences) <= least + 1 and any(r["fixed"] for r in rows)


def test_secret_query(spark):
    """Base spans by a scan that reads character by character."""
    sf = "/root/testdata/sf0.01"
    value, digits = set(string.ascii_letters + string.digits + "+/_.=-"), set("0123456789abcdef")

    def scan(t):
        out, i = [], 0
        while i < len(t):
            name = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if t[i : i + len(w)].isascii() and t[i : i + len(w)].lower() == w), None)
            if name:
                j = i + len(name)
                j += t[j : j + 1] in ("'", '"') and j < len(t)
                while t[j : j + 1] == " ":
                    j += 1
                if t[j : j + 1] in (":", "=") and j < len(t):
                    j += 1
                    while t[j : j + 1] == " ":
                        j += 1
                    j += j < len(t) and t[j] in "'\""
                    k = j
                    while k < len(t) and t[k] in value:
                        k += 1
                    if k > j:
                        out += [(i, 0, k)] * (k - j >= 6)
                        i = k
                        continue
            i += 1
        for kind, start, least, chars in ((1, "AKIA", 20, set(string.ascii_uppercase + string.digits)), (2, "", 24, digits)):
            i = 0
            while i < len(t):
                k = i + len(start)
                if t.startswith(start, i):
                    while k < len(t) and t[k] in chars:
                        k += 1
                if t.startswith(start, i) and k > i + len(start):
                    out += [(i, kind, k)] * (k - i >= least)
                    i = k
                else:
                    i += 1
        return sorted(out)

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in QUERIES["op3_secret_scan"](spark, sf).collect():
        base = scan(docs[r["doc_id"]])
        seen += len(base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert r["base_sha256"] == hashlib.sha256(secrets.spans_string(base).encode()).hexdigest()
        assert r["spans"] == secrets.spans_string(base)  # these texts hold nothing else that is random
    assert seen > 0


def test_scores_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(0)
    net = quality.fit(["good text here"] * 3 + ["!!!! ####"] * 3, [1] * 3 + [0] * 3, epochs=2)
    for t in ("", "abc", "x" * 512, "".join(map(chr, rng.integers(32, 127, 1300)))):
        raw = t.encode()
        pooled = []
        for s in range(0, max(1, len(raw) - 64), 448):
            chunk = raw[s : s + 512].ljust(512, b"\0")
            best = np.max([[sum(net.table[j, chunk[i + j], f] for j in range(5)) for f in range(16)] for i in range(508)], 0)
            pooled.append(np.tanh(np.maximum(best + net.bias, 0)))
        want = 1 / (1 + np.exp(-(np.mean(pooled, 0) @ net.weight + net.offset)))
        assert abs(net.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] - want) < 1e-5
