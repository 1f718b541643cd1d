"""Token counts without tokens: a count-only Viterbi over Aho-Corasick matches of a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, blocks, kept, mapped, texts

#: What an unknown character scores below the vocabulary's lowest piece; a fixed value of unigram tokenizers.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers before it starts anew.
CACHE_WORDS = 400_000

SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class UnigramCounter:
    """Counts the pieces of a unigram tokenizer's best segmentation.

    The vocabulary is that of a sentencepiece file, its pieces and scores read
    as a unigram model with byte fallback. Blanks become U+2581 and one more
    stands in front of a text that isn't empty. An unknown character counts one piece per UTF-8
    byte. Ties: of equally good segmentations the one whose last piece starts
    first wins at each position, as in the tokenizers' own search; sums are
    taken from left to right in double precision.

    No piece holds U+2581 after another character, so a text falls apart before
    each run of U+2581 and the parts are counted alone (checked on loading;
    otherwise texts are counted whole).
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((model.get_score(i) for i in range(model.vocab_size())), default=0.0) - UNKNOWN_PENALTY
        self.apart = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.known: dict[str, int] = {}

    def count_part(self, part: str) -> int:
        """Pieces of the best segmentation; each position carries its best score and count, nothing else."""
        n, unknown, none = len(part), self.unknown, float("-inf")
        best = [none] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        # `open_` is the position whose matches are being read; a position that no one-character
        # piece reaches is also reached by an unknown character, compared last.
        open_, single = 0, True
        for last, (length, score) in self.automaton.iter(part):
            end = last + 1
            while open_ < end:
                if not single and (one := best[open_ - 1] + unknown) > best[open_]:
                    best[open_], count[open_] = one, count[open_ - 1] + len(part[open_ - 1].encode("utf-8", "surrogatepass"))
                open_ += 1
                single = False
            # Longer pieces come first, so an equal score of a later start doesn't replace an earlier one.
            start = end - length
            if (found := best[start] + score) > best[end]:
                best[end], count[end] = found, count[start] + 1
            if length == 1:
                single = True
        while open_ <= n:
            if not single and (one := best[open_ - 1] + unknown) > best[open_]:
                best[open_], count[open_] = one, count[open_ - 1] + len(part[open_ - 1].encode("utf-8", "surrogatepass"))
            open_ += 1
            single = False
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self.count_part(text)
        known, parts = self.known, _PARTS.findall(text)
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set(parts).difference(known)
        fresh = {p: self.count_part(p) for p in new}
        known.update((p, n) for p, n in fresh.items() if len(p) <= 64)
        fresh = {p: n for p, n in fresh.items() if len(p) > 64}
        if fresh:
            return sum(fresh[p] if p in fresh else known[p] for p in parts)
        return sum(map(known.__getitem__, parts))


@kept
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(path)


def token_counts(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, n_tokens and n_chars (code points).

    Null and empty texts have no token. Repeated rows are counted each. Other
    columns are ignored, whatever their names. An empty table gives an empty one.
    `vocabulary` is the path of a sentencepiece file on every executor.
    """
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in blocks(batches):
            found = texts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.count(t) for t in found], pa.int64()), pa.array([len(t) for t in found], pa.int64())], names=[id_column, "n_tokens", "n_chars"])

    return mapped(rows, run, f"`{id_column}` {kind.simpleString()}, n_tokens long, n_chars long")
