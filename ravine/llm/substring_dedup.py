"""Removal of repeated passages: paragraphs by MinHash banding and exact Jaccard similarity, passages word by word.

A paragraph is a line of at least `min_words` words. Paragraphs that share a MinHash band (see
buckets) are compared by the exact Jaccard similarity of their word shingles, bucket by bucket.
Components of the verified links alone are the groups; the first paragraph of a group, by
(doc_id, paragraph), stays and the others are removed.

A passage can also be repeated inside longer paragraphs, where it says little of their
similarity, or run over shorter lines. So word shingles of PASSAGE words, the least by hash of
every WINDOW neighbours (winnowing; Schleimer, Wilkerson and Aiken 2003), are looked up in the
text that is left of the first step. A sample that occurs before is only a candidate: the words
around its first occurrence are fetched and compared one by one, and what is removed is the
stretch that equals them. The samples depend on content alone, and every PASSAGE + WINDOW - 1
= 50 words hold one, so every repeat of 50 words is met.

So nothing is removed but whole paragraphs similar to one of their group, and words that stand
in the same order at an earlier place of the text that the first step leaves; followed back,
these places end at one that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.llm.buckets import band_keys, digest, name, shingle_hashes, shingles_of, similar_links, units, word_hashes
from ravine.llm.common import discard, lowered_words, packed, slabs, stored, unpacked
from ravine.llm.components import components

#: Words of a shingle that samples passages, and shingles of which the least is taken.
PASSAGE, WINDOW = 32, 19
#: A stretch of equal words.
_SAME = re.compile(b"\x01{%d,}" % PASSAGE)
#: Words of a block in which the surroundings of a first occurrence are fetched.
_BLOCK = 64
#: Texts, and bytes of texts but for the last one, whose words are hashed together.
_ROWS, _BYTES = 256, 1 << 20


def paragraphs(text: str | None, min_words: int) -> list[tuple[int, list[bytes]]]:
    """(number, lower-case words) of the lines that have min_words words."""
    lines = ((i, lowered_words(x)) for i, x in enumerate((text or "").split("\n")))
    return [(i, w) for i, w in lines if len(w) >= min_words]


def leftmost_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Where the least of each window of values lies first; fewer values make one window."""
    window, span = min(window, len(values)), 1
    at = np.arange(len(values))
    while span < window:
        step = min(span, window - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def passage_samples(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the sampled shingles of PASSAGE words, from all their hashes."""
    at = leftmost_minima(total, WINDOW)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, total[at]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, at = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))), 0
        while at < b.num_rows:
            cut = int(np.clip(np.searchsorted(size, size[at] + _BYTES), at + 1, at + _ROWS))
            yield b.slice(at, cut - at)
            at = cut


def _scanned(docs: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """docs (doc_id, hash, text) read once: a row for each paragraph, and one (at, key) for each sample."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, hash long, paragraph int, start int, words int, high long, low long, bands array<long>, at int, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            words, texts, found, halves = [], [0], [], []
            for i, x in enumerate(part.column("text").cast(pa.binary())):
                for n, line in enumerate((x.as_py() or b"").lower().split(b"\n")):
                    w = line.split()
                    if len(w) >= min_words:
                        found.append((i, n, len(words), len(w)))
                        halves.append(digest(w))
                    words += w
                texts.append(len(words))
            one = word_hashes(words)
            rows, numbers, starts, many = np.array(found, np.int32).reshape(-1, 4).T
            high, low = np.array(halves, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            bands = band_keys(shingles_of(one, starts, many, shingle)) if found else np.empty((0, 1), np.uint64)
            offsets = np.arange(len(found) + 1, dtype=np.int32) * bands.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.view(np.int64).ravel()))
            whole = shingle_hashes(one, PASSAGE) if len(one) >= PASSAGE else one[:0]
            places, keys = zip(*(passage_samples(whole[s : max(e - PASSAGE + 1, s)]) for s, e in zip(texts, texts[1:])))
            at, key = np.concatenate(places).astype(np.int32), np.concatenate(keys).view(np.int64)
            yield rows_of(part, rows, [numbers, starts - np.array(texts, np.int32)[rows], many, high, low, lists, None, None])
            yield rows_of(part, np.repeat(np.arange(part.num_rows), [len(x) for x in places]), [None] * 6 + [at, key])

    types = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.list_(pa.int64()), pa.int32(), pa.int64()]

    def rows_of(part: pa.RecordBatch, rows: np.ndarray, columns: list) -> pa.RecordBatch:
        own = part.select(["doc_id", "hash"]).take(pa.array(rows))
        arrays = [pa.nulls(len(rows), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([*own.columns, *arrays], names=["doc_id", "hash", "paragraph", "start", "words", "high", "low", "bands", "at", "key"])

    return docs.select("doc_id", "hash", "text").mapInArrow(run, schema)


def _shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    words = [lowered_words(x) for x in texts]
    sizes = [len(w) for w in words]
    one = word_hashes([x for w in words for x in w])
    return [np.unique(x) for x in shingles_of(one, list(accumulate(sizes[:-1], initial=0)), sizes, shingle)]


def _unit_links(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "unit"):
            unit = slab.column("unit").to_numpy()
            names, texts = slab.column("node").to_pylist(), slab.column("text").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            for s, e in zip(cuts, [*cuts[1:], len(unit)]):
                if e - s > 1:
                    sets = [x for k in range(s, e, _ROWS) for x in _shingle_sets(texts[k : min(k + _ROWS, e)], shingle)]
                    links = [(names[s + a], names[s + b]) for a, b in similar_links(sets, threshold)]
                    a, b = zip(*links) if links else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return run


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """lists' rows by (doc_id, hash), beside the document's text."""
    lists = lists.withColumnsRenamed({"doc_id": "_i", "hash": "_h"})
    return docs.join(lists, docs.doc_id.eqNullSafe(lists._i) & (docs.hash == lists._h)).drop("_i", "_h")


def _paragraph_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (first, high, low): each class with the text of its first paragraph, through one join with docs."""
    lists = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash")).agg(
        F.collect_list(F.struct(F.col("first.paragraph").alias("paragraph"), "high", "low")).alias("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, wanted in zip(b.column("text"), b.column("wanted").to_pylist()):
                lines = x.as_py().split("\n")
                rows += [(w["high"], w["low"], lines[w["paragraph"]]) for w in wanted]
            high, low, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(texts, pa.string())], names=["high", "low", "text"])

    both = _with_texts(docs, lists).select("text", "wanted")
    return both.mapInArrow(run, "high long, low long, text string").dropDuplicates(["high", "low"])


def removable(docs: DataFrame, scanned: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, hash, paragraph, start, words, kept_doc_id, kept_paragraph): paragraphs to remove, and which one stays for each.

    docs has doc_id, text and hash, the 64-bit hash of text; scanned is what _scanned() makes of it.
    """
    found = scanned.where("paragraph is not null")
    place = F.struct("doc_id", "paragraph", "hash")
    classes = found.groupBy("high", "low").agg(F.min(F.struct(place.alias("first"), "words", "bands")).alias("c"), F.count("*").alias("n"))
    classes = stored(classes.select("high", "low", "c.first", "c.words", "c.bands", "n"), "classes")
    met = units(classes)
    wanted = classes.join(met.select("high", "low").distinct(), ["high", "low"], "left_semi").select("first", "high", "low")
    texts = stored(_paragraph_texts(docs, wanted), "texts")
    dealt = met.join(texts, ["high", "low"]).select("unit", name(), "text").repartition("unit").sortWithinPartitions("unit")
    groups = components(dealt.mapInArrow(_unit_links(shingle, threshold), "a string, b string"), "a", "b")
    discard(met, texts)
    named = classes.select("high", "low", name(), "first", "n")
    grouped = named.join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "node")).where("n > 1 or _node is not null")
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"))
    final = stored(grouped.join(kept, "root").select("high", "low", "kept"), "kept")
    discard(classes)
    gone = found.join(final, ["high", "low"]).where(~place.eqNullSafe(F.col("kept")))
    out = gone.select(
        "doc_id", "hash", "paragraph", "start", "words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.paragraph").alias("kept_paragraph")
    )
    out = stored(out, "lines")
    discard(final)
    return out


def passages(docs: DataFrame, scanned: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, hash, start_word, words, kept_doc_id): repeats to remove, by places among a text's words.

    gone (doc_id, hash, start, words) are the paragraphs that are removed already.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    samples = scanned.where("at is not null").select("doc_id", "hash", "at", "key")
    several = stored(samples.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    found = stored(samples.join(several, "key", "left_semi"), "found")
    discard(several)
    # a sample goes if a removed paragraph that starts before its end ends behind its start
    cuts = gone.select("doc_id", "hash", (F.col("start") - PASSAGE + 1).alias("at"), F.lit(None).cast("long").alias("key"), (F.col("start") + F.col("words")).alias("end"))
    before = Window.partitionBy("doc_id", "hash").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    marked = found.select("doc_id", "hash", "at", "key", F.lit(None).cast("int").alias("end")).union(cuts).withColumn("end", F.max("end").over(before))
    left = stored(marked.where("key is not null and coalesce(end, 0) <= at").drop("end"), "left")
    discard(found)
    place = F.struct("doc_id", "hash", "at")
    first = stored(left.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    hits = left.join(first, "key").where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "hash", "at", F.col("first.doc_id").alias("f_id"), F.col("first.hash").alias("f_hash"), (F.col("at") - F.col("first.at")).alias("shift")
    )
    # samples on one diagonal that could lie in one repeat are compared as one range, with what could lie around them
    same = Window.partitionBy("doc_id", "hash", "f_id", "f_hash", "shift").orderBy("at")
    apart = F.coalesce((F.col("at") - F.lag("at").over(same) > PASSAGE + WINDOW).cast("int"), F.lit(1))
    runs = hits.withColumn("run", apart).withColumn("run", F.sum("run").over(same))
    runs = runs.groupBy("doc_id", "hash", "f_id", "f_hash", "shift", "run").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    runs = stored(runs.select("doc_id", "hash", "f_id", "f_hash", "shift", (F.col("start") - WINDOW).alias("start"), (F.col("end") + PASSAGE + WINDOW).alias("end")), "runs")
    low = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("shift")) / _BLOCK))
    blocks = runs.withColumn("block", F.explode(F.sequence(low.cast("int"), F.floor((F.col("end") - F.col("shift")) / _BLOCK).cast("int"))))
    removed = gone.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "words")).alias("gone"))
    removed = stored(removed.withColumnsRenamed({"doc_id": "_g", "hash": "_gh"}), "gone")

    def beside(lists: DataFrame) -> DataFrame:
        return lists.join(removed, lists.doc_id.eqNullSafe(removed._g) & (lists.hash == removed._gh), "left").drop("_g", "_gh")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (x, wanted, gone) in enumerate(zip(b.column("text"), b.column("blocks"), b.column("gone"))):
                words, wanted = _left(x.as_py(), gone.as_py()), wanted.as_py()
                wanted = [k for k in wanted if k * _BLOCK < len(words)]
                own = b.select(["doc_id", "hash"]).take(pa.array([i] * len(wanted), pa.int64()))
                data = [b" ".join(words[k * _BLOCK : (k + 1) * _BLOCK]) for k in wanted]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(wanted, pa.int32()), pa.array(data, pa.binary())], names=["f_id", "f_hash", "block", "data"])

    firsts = blocks.groupBy(F.col("f_id").alias("doc_id"), F.col("f_hash").alias("hash")).agg(F.collect_set("block").alias("blocks"))
    data = stored(_with_texts(docs, beside(firsts)).mapInArrow(cut, f"f_id {kind}, f_hash long, block int, data binary"), "blocks")
    b, d = blocks.alias("b"), data.withColumnsRenamed({"f_id": "d_id", "f_hash": "d_hash", "block": "d_block"}).alias("d")
    got = b.join(d, F.col("b.f_id").eqNullSafe(F.col("d.d_id")) & (F.col("b.f_hash") == F.col("d.d_hash")) & (F.col("b.block") == F.col("d.d_block")))
    lists = got.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("f_id", "f_hash", "shift", "start", "end", "block", "data")).alias("hits"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, many, kept = [], [], [], []
            ends, fields = b.column("hits").offsets.to_pylist(), b.column("hits").values.flatten()
            for i, (x, gone) in enumerate(zip(b.column("text"), b.column("gone"))):
                hits = zip(*(f.slice(ends[i], ends[i + 1] - ends[i]).to_pylist() for f in fields))
                for holder, s, e in _repeats(_left(x.as_py(), gone.as_py(), b" "), hits):
                    rows.append(i)
                    starts.append(s)
                    many.append(e - s)
                    kept.append(holder)
            own = b.select(["doc_id", "hash"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(starts, pa.int32()), pa.array(many, pa.int32()), pa.array(kept, own.column(0).type)],
                names=["doc_id", "hash", "start_word", "words", "kept_doc_id"],
            )

    out = stored(_with_texts(docs, beside(lists)).mapInArrow(compare, f"doc_id {kind}, hash long, start_word int, words int, kept_doc_id {kind}"), "passages")
    discard(left, first, runs, removed, data)
    return out


def _left(text: str, gone: list[dict] | None, blank: bytes = b"") -> list[bytes]:
    """The text's words, in lower case; those of removed paragraphs are blank, which no word is."""
    words = lowered_words(text)
    for g in gone or ():
        words[g["start"] : g["start"] + g["words"]] = [blank] * g["words"]
    return words


def _repeats(words: list[bytes], hits: Iterable[tuple]) -> list[tuple]:
    """(holder, start, end) stretches, one after another, of words that equal the holder's, cut from stretches of PASSAGE words or more.

    hits are (holder's id and hash, shift, start, end, block, data): the blocks of the holders' words beside the
    ranges in which they are to be compared. The words' blanks are others than the holders'. Of equal
    stretches the one of the smallest holder is taken.
    """
    ranges: dict[tuple, dict[int, bytes]] = {}
    for *key, block, data in hits:
        ranges.setdefault(tuple(key), {})[block] = data
    found = []
    for (holder, _, shift, start, end), blocks in ranges.items():
        first = min(blocks)
        base = first * _BLOCK
        theirs = b" ".join([blocks[k] for k in range(first, first + len(blocks))]).split(b" ")
        low = max(start, base + shift, 0)
        same = bytes(map(eq, words[low:end], theirs[low - shift - base :]))
        found += [(low + m.start(), low + m.end(), holder) for m in _SAME.finditer(same)]
    out, at = [], 0
    found.sort(key=lambda r: (*r[:2], r[2] is not None, r[2]))
    i = 0
    while i < len(found):
        # of the stretches that begin where the one before ends, or earlier, the one that ends last
        at = max(at, found[i][0])
        best = found[i]
        while i < len(found) and found[i][0] <= at:
            best = max(best, found[i], key=lambda r: r[1])
            i += 1
        if best[1] > at:
            out.append((best[2], at, best[1]))
            at = best[1]
    return out


def _to_remove(docs: DataFrame, min_words: int, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """removable() and passages() of docs (doc_id, text, hash), as tables."""
    scanned = stored(_scanned(docs, min_words, shingle), "scanned")
    lines = removable(docs, scanned, shingle, threshold)
    inside = passages(docs, scanned, lines.select("doc_id", "hash", "start", "words"))
    discard(scanned)
    return lines, inside


def repeated_paragraphs(docs: DataFrame, min_words: int = 25, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """What is to be removed: doc_id, paragraph, start_word, words, kept_doc_id, kept_paragraph.

    A repeated paragraph has its line number from 0 in paragraph, a repeated passage the place of
    its first word in start_word (the other one is null); passages do not reach into such
    paragraphs and do not overlap. docs needs doc_id and text; other columns are not
    read. Rows that agree in doc_id and text count as one document, reported once. Of equal
    places the one with the smaller (doc_id, hash of the text) counts as earlier; a null doc_id
    comes first. Null and empty texts have no paragraphs; an empty table gives an empty table.
    """
    lines, inside = _to_remove(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), min_words, shingle, threshold)
    lines = lines.drop("start").withColumn("start_word", F.lit(None).cast("int"))
    inside = inside.withColumns({"paragraph": F.lit(None).cast("int"), "kept_paragraph": F.lit(None).cast("int")})
    return lines.unionByName(inside).distinct().drop("hash")


def remove_paragraphs(docs: DataFrame, min_words: int = 25, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with `text` rid of the paragraphs and passages to remove; all columns are kept, and rows that lose nothing are as they were."""
    keyed = docs.select(packed(docs).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    lines, inside = _to_remove(keyed.select("doc_id", "text", F.col("_hash").alias("hash")), min_words, shingle, threshold)
    lines = lines.select("doc_id", "hash", F.struct("paragraph", F.lit(None).cast("int").alias("start"), "words").alias("cut"))
    inside = inside.select("doc_id", "hash", F.struct(F.lit(None).cast("int").alias("paragraph"), F.col("start_word").alias("start"), "words").alias("cut"))
    lists = lines.union(inside).groupBy(F.col("doc_id").alias("_i"), F.col("hash").alias("_h")).agg(F.collect_set("cut").alias("_gone"))
    both = keyed.join(lists, keyed.doc_id.eqNullSafe(lists._i) & (keyed._hash == lists._h), "left").select("_row", "text", "_gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column("_gone").to_pylist()
            texts = [without(x.as_py(), g) if g else x.as_py() for x, g in zip(b.column("text"), gone)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string())], names=["_row", "_new"])

    told = both.mapInArrow(cut, T.StructType([both.schema["_row"], T.StructField("_new", T.StringType())]))
    named = told.select(*unpacked(told, "_row", "text"), F.col("_new").alias("text"))
    return named.select(*(f"`{c}`" for c in docs.columns))


def without(text: str, cuts: list[dict]) -> str:
    """text without whole lines (paragraph) and stretches of words (start, words)."""
    data = text.encode("utf-8")
    lines, out = {c["paragraph"] for c in cuts if c["start"] is None}, bytearray(len(data))
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    for c in cuts:
        if c["start"] is not None:
            s, e = spans[c["start"]][0], spans[c["start"] + c["words"] - 1][1]
            out[s:e] = b"\1" * (e - s)
    kept, at = [], 0
    for n, line in enumerate(data.split(b"\n")):
        marks = out[at : at + len(line)]
        if n not in lines and not (line and marks.count(1) == len(line)):
            kept.append(bytes(c for c, m in zip(line, marks) if not m) if any(marks) else line)
        at += len(line) + 1
    return b"\n".join(kept).decode("utf-8")
