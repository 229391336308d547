"""Scores of texts under an interpolated modified Kneser-Ney bigram model.

Chen and Goodman (1998). Everything is counted in Spark: words by their 64-bit hash, then
pairs of word numbers, a word's number being its place in the sorted array of hashes. The
model is a folder of sorted hash arrays, cut into parts by leading bits, each a .npy file that
workers map into memory: only the pages that a lookup touches are read, and they are shared by
all workers of a machine. The folder lies in the shared folder; where that is no mounted one
(hdfs, s3), a worker first copies the parts that it needs. A part that the model has and the
folder has not is an error.

    p(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + g(u) p1(w)
    p1(w)    = max(n(w) - E(n(w)), 0) / pairs + g1 / (V + 1)

with n(w) the number of different words seen before w, V the number of different words and one
place for all unseen words, and g, g1 what the discounts leave, so that both sum up to 1.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.llm.common import discard, each_key, lowered_words, shared_dir, stored

#: Hashes of the end of a text and of the place before its first word; no word holds white space.
_END = xxhash.xxh3_64_intdigest(b"\n")
#: Rows of a part of a sorted array, about, and characters of the texts that are looked up together.
_PART, _CHARS = 1 << 20, 3_000_000


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that all texts share."""

    folder: str
    word_bits: int
    pair_bits: int
    tokens: int
    words: int
    pairs: int
    first_words: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_rest: float
    start_rest: float
    word_parts: frozenset[int]
    pair_parts: frozenset[int]

    def delete(self) -> None:
        """Remove the files, once nothing scores with them any more."""
        system, path = _located(self.folder)
        system.delete_dir(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a path on this machine, and the path there."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class Arrays:
    """Sorted arrays in parts by leading bits, mapped when first used; parts are those that the model has."""

    def __init__(self, folder: str, name: str, bits: int, parts: frozenset[int]):
        self.system, self.folder = _located(folder)
        self.name, self.bits, self.parts, self.open = name, bits, parts, {}

    def part(self, field: str, k: int) -> np.ndarray:
        if (field, k) not in self.open:
            path = f"{self.folder}/{self.name}-{field}-{k}.npy"
            if not isinstance(self.system, fs.LocalFileSystem):
                path = self._copied(path)
            self.open[field, k] = np.load(path, mmap_mode="r")
        return self.open[field, k]

    def _copied(self, path: str) -> str:
        """A copy of a part on this machine; workers that copy at the same time replace each other's whole."""
        own = f"{tempfile.gettempdir()}/kneser-ney-{hashlib.md5(path.encode()).hexdigest()}.npy"
        if not os.path.exists(own):
            temporary = f"{own}.{uuid.uuid4().hex}"
            fs.copy_files(path, temporary, source_filesystem=self.system, destination_filesystem=fs.LocalFileSystem())
            os.replace(temporary, own)
        return own

    def find(self, keys: np.ndarray, *fields: str) -> list[np.ndarray]:
        """The fields of each of the sorted keys, 0 where a key is absent."""
        out = [np.zeros(len(keys), np.float64 if f == "rest" else np.int64) for f in fields]
        part = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(keys), np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(keys) else []
        for s, e in zip(cuts, [*cuts[1:], len(keys)]):
            k = int(part[s])
            if k not in self.parts:
                continue
            all_keys = self.part("key", k)
            at = np.searchsorted(all_keys, keys[s:e])
            at[at == len(all_keys)] = 0
            there = np.flatnonzero(all_keys[at] == keys[s:e])
            for o, f in zip(out, fields):
                o[s:e][there] = self.part(f, k)[at[there]]
        return out

    def each(self, keys: np.ndarray, *fields: str) -> list[np.ndarray]:
        """find() for keys in any order."""
        different, back = np.unique(keys, return_inverse=True)
        return [x[back] for x in self.find(different, *fields)]


def _written(folder: str, name: str, k: int, array: np.ndarray) -> None:
    """Write a part so that a repeated task replaces it whole."""
    system, path = _located(folder)
    data, temporary = io.BytesIO(), f"{path}/.{uuid.uuid4().hex}.npy"
    np.save(data, array)
    with system.open_output_stream(temporary) as out:
        out.write(data.getbuffer())
    system.move(temporary, f"{path}/{name}-{k}.npy")


def _groups(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes with an end after each text, places of the ends), a few texts at a time."""
    texts = batch.column(batch.schema.get_field_index(text))
    start, hashes, ends, chars, at = 0, [], [], 0, 0
    digest = xxhash.xxh3_64_intdigest
    for i, x in enumerate(texts):
        words = lowered_words(x.as_py())
        hashes.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        hashes.append(np.array([_END], np.uint64))
        at += len(words) + 1
        ends.append(at - 1)
        chars += sum(map(len, words[:1])) + len(words) * 6
        if chars > _CHARS or i == len(texts) - 1:
            yield start, np.concatenate(hashes), np.array(ends)
            start, hashes, ends, chars, at = i + 1, [], [], 0, 0


def _pairs(ids: np.ndarray, ends: np.ndarray, start_id: int) -> np.ndarray:
    """(number of the word before) << 32 | number of the word."""
    before = np.concatenate(([start_id], ids[:-1]))
    before[ends[:-1] + 1] = start_id
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _bits(rows: int) -> int:
    return max(0, (rows // _PART).bit_length())


def _parts(df: DataFrame, key: str, bits: int) -> DataFrame:
    part = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    return df.withColumn("part", part).repartition("part").sortWithinPartitions("part")


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things that occur 1, 2, 3 and 4 times."""
    one, two, three, four = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (one and two and three):
        return 0.5, 1.0, 1.5
    y = one / (one + 2 * two)
    raw = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


def _histogram(df: DataFrame, column: str) -> dict[int, int]:
    rows = df.groupBy(F.least(column, F.lit(5)).alias("c")).agg(F.count("*").alias("n")).collect()
    return {r["c"]: r["n"] for r in rows}


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    """Count docs' texts and write the model; a null text counts as an empty one.

    folder: a path or URI that the driver and all workers reach, by default a new one in the
    shared folder.
    Word numbers take 32 bits, so up to 4 billion different words.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    system, path = _located(folder)
    system.create_dir(path)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, hashes, _ in _groups(b, text):
                key, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = docs.select(text).mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    size = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    word_bits = _bits(size["v"])
    sizes = {
        r["part"]: r["n"]
        for r in counted.select((F.shiftrightunsigned("key", 64 - word_bits) if word_bits else F.lit(0)).alias("part"))
        .groupBy("part").agg(F.count("*").alias("n")).collect()
    }
    before = {k: sum(n for j, n in sizes.items() if j < k) for k in sizes}

    def word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in each_key(batches, "part"):
            k = slab.column("part")[0].as_py()
            key = slab.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            _written(folder, "word-key", k, key[order])
            _written(folder, "word-count", k, slab.column("n").to_numpy()[order])
            _written(folder, "word-id", k, np.arange(len(key)) + before[k])
            yield pa.RecordBatch.from_arrays([pa.array([k])], names=["part"])

    word_names = frozenset(r["part"] for r in _parts(counted, "key", word_bits).mapInArrow(word_parts, "part long").collect())
    discard(counted)
    start_id = size["v"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Arrays(folder, "word", word_bits, word_names)
        for b in batches:
            for _, hashes, ends in _groups(b, text):
                (ids,) = known.each(hashes, "id")
                key, n = np.unique(mixed(_pairs(ids, ends, start_id)), return_counts=True)
                ids = unmixed(key)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], names=["pair", "n"])

    seen = docs.select(text).mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    seen = stored(seen, "pairs")
    many = seen.count()
    pair_bits = _bits(many)
    by_count = _histogram(seen, "n")
    left, right = F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    after = seen.groupBy(left.alias("id")).agg(
        F.sum("n").alias("total"), *(F.count_if(F.least("n", F.lit(3)) == k).alias(f"n{k}") for k in (1, 2, 3))
    )
    ahead = seen.groupBy(right.alias("id")).agg(F.count("*").alias("seen_after"))
    d = _discounts(by_count)
    rest = sum(F.col(f"n{k}") * F.lit(d[k - 1]) for k in (1, 2, 3)) / F.col("total")
    zero = F.lit(0).cast("long")
    stats = after.select("id", zero.alias("seen_after"), "total", rest.alias("rest")).union(
        ahead.select("id", "seen_after", zero, F.lit(0.0))
    )
    stats = stats.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("seen_after", "total", "rest")))
    stats = stored(stats, "contexts")
    lower = _discounts(by_words := _histogram(stats.where("seen_after > 0"), "seen_after"))
    above = sum(n for c, n in by_words.items() if c >= 3)
    lower_rest = (lower[0] * by_words.get(1, 0) + lower[1] * by_words.get(2, 0) + lower[2] * above) / many if many else 1.0
    first = stats.where(F.col("id") == start_id).first()
    starts = np.array(sorted(before.values()))
    names = [k for k, _ in sorted(before.items(), key=lambda x: x[1])]

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(starts, b.column("id").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    def context_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in each_key(batches, "part"):
            k = slab.column("part")[0].as_py()
            place = slab.column("id").to_numpy() - starts[k]
            for f, kind in (("seen_after", np.int64), ("total", np.int64), ("rest", np.float64)):
                dense = np.zeros(sizes[names[k]], kind)
                dense[place] = slab.column(f).to_numpy()
                _written(folder, f"word-{f}", names[k], dense)
            yield pa.RecordBatch.from_arrays([pa.array([k])], names=["part"])

    def pair_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in each_key(batches, "part"):
            k = slab.column("part")[0].as_py()
            key = slab.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            _written(folder, "pair-key", k, key[order])
            _written(folder, "pair-count", k, slab.column("n").to_numpy()[order].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([k])], names=["part"])

    def mixed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mixed(b.column("pair").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("n")], names=["key", "n"])

    pair_names: frozenset[int] = frozenset()
    if many:
        placed = stats.where(F.col("id") != start_id).mapInArrow(owned, T.StructType([*stats.schema, T.StructField("part", T.LongType())]))
        placed.repartition("part").sortWithinPartitions("part").mapInArrow(context_parts, "part long").count()
        written = _parts(seen.mapInArrow(mixed_pairs, "key long, n long"), "key", pair_bits).mapInArrow(pair_parts, "part long")
        pair_names = frozenset(r["part"] for r in written.collect())
    model = Model(
        folder, word_bits, pair_bits, int(size["n"]), size["v"], many, int(first["total"]) if first else 0, d, lower, lower_rest,
        float(first["rest"]) if first else 1.0, word_names, pair_names,
    )
    discard(seen, stats)
    return model


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of mixed()."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' other columns than text, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words and one end. base_score is the log10 probability of the text under
    add-a-half unigrams, score that under the model. A null text counts as empty: its end alone.
    Columns with these names are replaced; each row stands for itself.
    """
    added = [("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")]
    rest = [c for c in docs.columns if c != text and c not in dict(added)]
    out = T.StructType([docs.schema[c] for c in rest])
    for n, kind in added:
        out = out.add(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Arrays(model.folder, "word", model.word_bits, model.word_parts)
        seen = Arrays(model.folder, "pair", model.pair_bits, model.pair_parts)
        floor = model.tokens + 0.5 * (model.words + 1)
        for b in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for _, hashes, ends in _groups(b, text):
                starts = np.concatenate(([0], ends[:-1] + 1))
                if model.tokens:
                    count, ids, before, total, left = words.each(hashes, "count", "id", "seen_after", "total", "rest")
                    ids[count == 0] = 0xFFFFFFFF
                    (pair,) = seen.each(mixed(_pairs(ids, ends, model.words)), "count")
                else:
                    count = ids = before = total = pair = np.zeros(len(hashes), np.int64)
                    left = np.zeros(len(hashes))
                total, left = np.concatenate(([0], total[:-1])), np.concatenate(([0.0], left[:-1]))
                total[starts], left[starts] = model.first_words, model.start_rest
                lower = _discounted(before, model.lower_discounts) / max(model.pairs, 1) + model.lower_rest / (model.words + 1)
                known = total > 0
                p = np.where(known, _discounted(pair, model.discounts) / np.maximum(total, 1) + left * lower, lower)
                columns[0].append(ends - starts + 1)
                columns[1].append(np.add.reduceat((count > 0).astype(np.int64), starts))
                columns[2].append(np.add.reduceat(np.log10((count + 0.5) / floor), starts))
                columns[3].append(np.add.reduceat(np.log10(p), starts))
            if not columns[0]:
                continue
            tokens, known, base, total = (pa.array(np.concatenate(c)) for c in columns)
            n = pa.array(np.full(b.num_rows, model.tokens))
            own = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*own, tokens, known, n, base, total], names=[*rest, *dict(added)])

    return docs.select(*rest, text).mapInArrow(run, out)
