"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, computed by the
forward algorithm; a text's is the product over its words, its maximal runs of letters in
lower case. A character outside the vocabulary is spelt by its UTF-8 bytes' pieces. The piece
probabilities are trained by expectation maximisation (forward-backward), in Spark, on the
word counts of a bounded sample of labelled documents. Every whole text is scored.

A task keeps the words that it has scored, up to MOST_WORDS, since words come back often.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.llm.common import discard, packed, stored, unpacked
from ravine.llm.pieces import SPACE, Vocabulary, load

UNDETERMINED = "und"
#: Scored words that a task keeps.
MOST_WORDS = 300_000
#: A run of letters: word characters other than digits and the underscore.
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters from which on a word is scored place by place, in memory that does not follow its length.
_LONG = 1024
#: Words with a probability below are computed again by logarithms, so that it does not vanish.
_TINY = 1e-250


class Lattice:
    """Piece matches of words, and the forward and backward sums over them, for all languages at once."""

    def __init__(self, pieces: tuple[str, ...], table: np.ndarray):
        """table: (pieces + 256 byte pieces, languages) probabilities."""
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.bytes_at = len(pieces)
        self.none = len(table)
        self.table = np.vstack([table, np.zeros((1, table.shape[1]))])
        self.spelt: dict[str, int] = {}

    def piece(self, char: str) -> int:
        """The row of a single character, made of its bytes' rows if it is no piece."""
        if char in self.ids:
            return self.ids[char]
        if char not in self.spelt:
            row = np.prod([self.table[self.bytes_at + b] for b in char.encode("utf-8", "surrogatepass")], axis=0)
            self.spelt[char] = len(self.table)
            self.table = np.vstack([self.table, row])
        return self.spelt[char]

    def matches(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Rows of the pieces [i:j] of words of one length; spans that match in no word are left out."""
        n, get, out = len(words[0]), self.ids.get, {}
        for i in range(n):
            singles = np.fromiter((self.piece(w[i]) for w in words), np.int64, len(words))
            out[i, i + 1] = singles
            for j in range(i + 2, min(n, i + self.longest) + 1):
                rows = np.fromiter((get(w[i:j], self.none) for w in words), np.int64, len(words))
                if (rows != self.none).any():
                    out[i, j] = rows
        return out

    def forward(self, n: int, at: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """alpha (position, word, language) of words of n letters; at goes by the pieces' starts."""
        alpha = np.zeros((n + 1, len(at[0, 1]), self.table.shape[1]))
        alpha[0] = 1.0
        for (i, j), rows in at.items():
            alpha[j] += alpha[i] * self.table[rows]
        return alpha

    def logs(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.table[rows])

    def log_forward(self, n: int, at: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """The logarithms of alpha, for words whose alpha would vanish."""
        alpha = np.full((n + 1, len(at[0, 1]), self.table.shape[1]), -np.inf)
        alpha[0] = 0.0
        for (i, j), rows in at.items():
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.logs(rows))
        return alpha

    def log_long(self, word: str) -> np.ndarray:
        """log P(word) by language, with only the alphas that a piece can reach back to, scaled at every place."""
        size, get = self.longest + 1, self.ids.get
        alpha, total = np.zeros((size, self.table.shape[1])), np.zeros(self.table.shape[1])
        alpha[0] = 1.0
        for j in range(1, len(word) + 1):
            rows, back = [self.piece(word[j - 1])], [(j - 1) % size]
            for i in range(max(0, j - self.longest), j - 1):
                row = get(word[i:j])
                if row is not None:
                    rows.append(row)
                    back.append(i % size)
            now = (alpha[back] * self.table[rows]).sum(axis=0)
            total += np.log(now)
            alpha /= now
            alpha[j % size] = 1.0
        return total

    def scores(self, words: list[str]) -> np.ndarray:
        """log P(word) by language, (words, languages)."""
        out = np.empty((len(words), self.table.shape[1]))
        for n, at in _by_length(words):
            if n > _LONG:
                out[at] = [self.log_long(words[k]) for k in at]
                continue
            spans = self.matches([words[k] for k in at])
            last = self.forward(n, spans)[n]
            low = (last < _TINY).any(axis=1)
            out[at[~low]] = np.log(last[~low])
            if low.any():
                out[at[low]] = self.log_forward(n, {k: rows[low] for k, rows in spans.items()})[n]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and byte piece by language, for counts (words, languages)."""
        total = np.zeros((self.none, self.table.shape[1]))
        for n, of in _by_length(words):
            group = [words[k] for k in of]
            at = self.matches(group)
            alpha = self.forward(n, at)
            low = (alpha[n] < _TINY).any(axis=1)
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            for i, j in sorted(at, reverse=True):
                beta[i] += self.table[at[i, j]] * beta[j]
            weight = counts[of] / np.maximum(alpha[n], 1e-300)
            if low.any():
                at_low = {k: rows[low] for k, rows in at.items()}
                log_alpha = self.log_forward(n, at_low)
                log_beta = np.full_like(log_alpha, -np.inf)
                log_beta[n] = 0.0
                for i, j in sorted(at_low, reverse=True):
                    log_beta[i] = np.logaddexp(log_beta[i], self.logs(at_low[i, j]) + log_beta[j])
                log_word = np.where(np.isneginf(log_alpha[n]), 0.0, log_alpha[n])
            for (i, j), rows in at.items():
                use = alpha[i] * self.table[rows] * beta[j] * weight
                if low.any():
                    use[low] = np.exp(log_alpha[i] + self.logs(rows[low]) + log_beta[j] - log_word) * counts[of[low]]
                own = rows < self.none
                np.add.at(total, rows[own], use[own])
                for k in np.flatnonzero(rows > self.none):
                    for b in group[k][i].encode("utf-8", "surrogatepass"):
                        total[self.bytes_at + b] += use[k]
        return total


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        most = max(1, 20_000_000 // (int(n) + 1) // 64)
        for k in range(0, len(at), most):
            yield int(n), at[k : k + most]


@dataclass(frozen=True)
class Model:
    """Languages and their piece probabilities: (pieces + 256) rows, so its size is bounded by the vocabulary."""

    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    table: np.ndarray


def words_of(text: str) -> list[str]:
    return [SPACE + w for w in _LETTERS.findall(text.lower())]


def _word_counts(sample: DataFrame, languages: list[str]) -> DataFrame:
    """(word, counts): how often each word occurs in the sample by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        for b in batches:
            words, langs = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found = words_of(text or "")
                words += found
                langs += [place[lang]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(langs, pa.int32())], names=["word", "lang"])

    counted = sample.select("lang", "text").mapInArrow(run, "word string, lang int")
    each = [F.count_if(F.col("lang") == i).cast("double") for i in range(len(languages))]
    return counted.groupBy("word").agg(F.array(*each).alias("counts"))


def fit(
    labelled: DataFrame,
    vocabulary: Vocabulary | None = None,
    sample_docs: int = 1500,
    rounds: int = 3,
    smoothing: float = 0.01,
) -> Model:
    """Train on labelled (doc_id, text, lang); rows with a null text or lang are passed over.

    sample_docs bounds the sample: about that many documents of each language, those with the
    smallest hashes of doc_id. No labelled row gives a model without languages.
    """
    vocabulary = vocabulary or load()
    spark = labelled.sparkSession
    usable = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model((), vocabulary.pieces, np.zeros((len(vocabulary.pieces) + 256, 0)))
    share = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, sample_docs / sizes[k]))), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    counts = stored(_word_counts(usable.where(drawn), languages), "words")
    table = np.full((len(vocabulary.pieces) + 256, len(languages)), 1.0 / (len(vocabulary.pieces) + 256))
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((vocabulary.pieces, table))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shipped.value)
            total = np.zeros_like(shipped.value[1])
            for b in batches:
                n = np.array(b.column("counts").to_pylist()).reshape(b.num_rows, -1)
                total += lattice.expected(b.column("word").to_pylist(), n)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "uses"]
            )

        uses = counts.mapInArrow(run, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        table = np.full_like(table, smoothing)
        got = uses.toPandas()
        table[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["uses"].to_numpy()
        table /= table.sum(axis=0)
    discard(counts)
    return Model(tuple(languages), vocabulary.pieces, table)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' other columns than text, lang_pred and score (the best language's posterior, 0 to 1).

    All languages are equally likely beforehand; of equally likely ones the first by name is
    taken. A null text, a text without a letter, and every
    text under a model without languages gives `und` and score 0. Columns named lang_pred and
    score are replaced. Each row stands for itself, so repeated rows get equal results.
    """
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        lattice, known, table = Lattice(model.pieces, model.table), {}, np.zeros((0, len(model.languages)))
        for b in batches:
            langs, scores = [], []
            for k in range(0, b.num_rows, 256):
                part = b.column(b.schema.get_field_index(text)).slice(k, 256).to_pylist()
                found = [words_of(x) if x and model.languages else [] for x in part]
                new = list({w for ws in found for w in ws if w not in known})
                if len(known) + len(new) > MOST_WORDS:
                    known, table = {}, table[:0]
                    new = list({w for ws in found for w in ws})
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    table = _grown(table, len(known), lattice.scores(new))
                for words in found:
                    if not any(c.isalpha() for w in words for c in w[1:]):
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = table[[known[w] for w in words]].sum(axis=0)
                    odds = np.exp(total - total.max())
                    langs.append(model.languages[int(total.argmax())])
                    scores.append(float(1.0 / odds.sum()))
            columns = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest, text).mapInArrow(run, out)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without those whose language is undetermined or under `least` likely; all columns are kept."""
    told = predict(docs.select(packed(docs).alias("_row"), "text"), model)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*unpacked(told, "_row"))


def _grown(table: np.ndarray, rows: int, new: np.ndarray) -> np.ndarray:
    """table with new below, in a buffer that doubles; rows are its used rows afterwards."""
    used = rows - len(new)
    if rows > len(table):
        larger = np.empty((max(rows, 2 * len(table)), new.shape[1]))
        larger[:used] = table[:used]
        table = larger
    table[used:rows] = new
    return table
