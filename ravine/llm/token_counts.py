"""Token counts under a unigram vocabulary, by a Viterbi search that carries only counts.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic
programming keeps, per character, the best score and the number of pieces on the best path,
and no back pointers. Ties follow the public tokenizers' forward search, which replaces a
path only by a strictly better one and tries starts from left to right: among equal scores
the longest last piece wins. A character that is no piece scores 10 under the worst piece and
counts one token per UTF-8 byte (byte fallback), or one per run of such characters if the
vocabulary has no byte pieces.

Spaces become the vocabulary's space sign, and one is put before the text. If no piece holds a
space sign after another character (so in the public file), no piece crosses the beginning of
a word, and words are searched one by one; a task keeps the counts of the words it has seen,
up to MOST_UNITS.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ravine.llm.pieces import SPACE, Vocabulary, load

#: Counted words that a task keeps, and characters of the longest word that it keeps.
MOST_UNITS, KEPT_CHARS = 500_000, 64
_UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.byte_pieces = vocabulary.byte_pieces
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.scores) - _UNKNOWN_PENALTY
        splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in vocabulary.pieces)
        lines = splits and vocabulary.byte_pieces and not any("\n" in p for p in vocabulary.pieces)
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if splits else "(?s).+")
        self.known: dict[str, int] = {}

    def search(self, unit: str) -> int:
        """Pieces on the best path through unit."""
        if len(unit) > KEPT_CHARS:
            at, best, count, was_unknown = self._by_end(unit), array("d", [0.0]), array("q", [0]), bytearray(1)
        else:
            at, best, count, was_unknown = [[] for _ in unit], [0.0], [0], [False]
            for end, match in self.automaton.iter(unit):
                at[end].append(match)
        for end, (char, here) in enumerate(zip(unit, at)):
            top, n, unknown = float("-inf"), 0, False
            for length, score in sorted(here, reverse=True):
                start = end + 1 - length
                if best[start] + score > top:
                    top, n = best[start] + score, count[start] + 1
            if char not in self.singles and best[end] + self.unknown > top:
                top, unknown = best[end] + self.unknown, True
                width = len(char.encode("utf-8", "surrogatepass")) if self.byte_pieces else int(not was_unknown[end])
                n = count[end] + width
            best.append(top)
            count.append(n)
            was_unknown.append(unknown)
        return count[-1]

    def _by_end(self, unit: str) -> Iterator[list[tuple[int, float]]]:
        """The matches that end at each place, one place at a time, so that a very long word needs few bytes a letter."""
        held, at = [], 0
        for end, match in self.automaton.iter(unit):
            while at < end:
                yield held
                held, at = [], at + 1
            held.append(match)
        for _ in range(at, len(unit)):
            yield held
            held = []

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; none for null or the empty text."""
        if not text:
            return 0
        known, total = self.known, 0
        for unit in self.units.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(unit)
            if n is None:
                n = self.search(unit)
                if len(unit) <= KEPT_CHARS:
                    if len(known) >= MOST_UNITS:
                        known.clear()
                    known[unit] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text") -> DataFrame:
    """docs' other columns than text, and n_tokens; null and empty texts have 0.

    A column n_tokens is replaced; each row stands for itself.
    """
    rest = [c for c in docs.columns if c not in (text, "n_tokens")]
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary or load())
    out = T.StructType([docs.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value)
        for b in batches:
            n = [counter.count(x.as_py()) for x in b.column(b.schema.get_field_index(text))]
            columns = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    return docs.select(*rest, text).mapInArrow(run, out)
