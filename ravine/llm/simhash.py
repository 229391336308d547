"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint holds, for each of 64 bits, whether more than half of the hashes of a text's
word shingles have it set (Charikar 2002). Fingerprints that differ in at most `radius` bits
are linked. A BK-tree (Burkhard and Keller 1973) keys each child by its Hamming distance to
its parent; the triangle inequality lets a search follow only the edges within the radius.

One tree over all fingerprints could be neither broadcast (its size follows the input) nor
searched in much less than linear time, so the trees are sharded: the 64 bits are cut into
`radius` + 2 blocks, and two fingerprints within the radius agree on at least two whole
blocks. Each pair of blocks with its bits names a shard, and the trees travel to their
queries by shuffle. A shard of more than SHARD fingerprints is cut into several trees, each
met by all queries of the shard in parts, so no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.llm.buckets import BANDS, band_keys, digest, name, shingle_hashes, units, word_hashes
from ravine.llm.common import discard, local_roots, lowered_words, packed, popcount, slabs, stored, unpacked
from ravine.llm.components import components

#: Most fingerprints of a tree, and of the queries that meet it in one step.
SHARD = 1024
#: Shingles whose bits are added up at once.
_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles, 0 where there are no words."""
    words = lowered_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(first), _STEP):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first[i : i + _STEP], last[i : i + _STEP])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs' other columns than text, and `fingerprint` as a signed long; null texts count as empty."""
    rest = [c for c in docs.columns if c != text]
    out = T.StructType([docs.schema[c] for c in rest] + [T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.schema.get_field_index(text)
            prints = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(t)], "<u8").view("<i8")
            columns = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], names=[*rest, "fingerprint"])

    return docs.select(*rest, text).mapInArrow(run, out)


def bk_trees(group: np.ndarray, value: np.ndarray, in_tree: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The BK-trees of all groups side by side, as levels of (keys, nodes) sorted by key.

    The first value of each bucket becomes a node, and the others go to the bucket of their
    distance to it: a root's key is its group, a child's its parent and the distance.
    """
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    rest = np.flatnonzero(in_tree)
    bucket = group[rest].astype(np.int64)
    while rest.size:
        order = np.argsort(bucket, kind="stable")
        rest, bucket = rest[order], bucket[order]
        first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        nodes = rest[first]
        levels.append((bucket[first], nodes))
        parent = nodes[np.cumsum(first) - 1][~first]
        rest = rest[~first]
        distance = popcount(value[rest] ^ value[parent]).astype(np.int64)
        rest, bucket = rest[distance > 0], (parent * 65 + distance)[distance > 0]
    return levels


def bk_search(levels: list, group: np.ndarray, value: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, node), both of one group, whose values differ in 1 to radius bits.

    All queries go down the levels at once, along the edges whose distance the radius allows.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if not levels or not len(query):
        return found[0]
    keys, nodes = levels[0]
    at = np.minimum(np.searchsorted(keys, group[query]), len(keys) - 1)
    query, at = query[keys[at] == group[query]], at[keys[at] == group[query]]
    node = nodes[at]
    for keys, nodes in [*levels[1:], (np.empty(0, np.int64), np.empty(0, np.int64))]:
        distance = popcount(value[query] ^ value[node]).astype(np.int64)
        near = (distance <= radius) & (distance > 0)
        found.append((query[near], node[near]))
        low = np.searchsorted(keys, node * 65 + np.maximum(distance - radius, 1))
        high = np.searchsorted(keys, node * 65 + np.minimum(distance + radius, 64), side="right")
        many = high - low
        start = np.repeat(np.cumsum(many) - many, many)
        query, node = np.repeat(query, many), nodes[np.repeat(low, many) + np.arange(many.sum()) - start]
    return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def bk_links(group: np.ndarray, value: np.ndarray, in_tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """bk_search() of all values in the trees of those that are in_tree."""
    return bk_search(bk_trees(group, value, in_tree), group, value, np.arange(len(group)), radius)


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """(unit, fingerprint, in_tree): each shard's fingerprints, large shards in units of two parts."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    block = [
        F.shiftrightunsigned("fingerprint", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)
    ]
    keys = [F.xxhash64(F.lit(k), block[i], block[j]) for k, (i, j) in enumerate(combinations(range(n), 2))]
    keyed = prints.select("fingerprint", F.explode(F.array(*keys)).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > SHARD)
    large = large.select("shard", F.ceil(F.col("count") / SHARD).cast("long").alias("parts"))
    parted = keyed.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64(F.lit("part"), "fingerprint"), F.col("parts"))
    met = parted.select("shard", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    return met.select(
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        "fingerprint",
        (F.col("own") <= F.col("other")).alias("in_tree"),
    )


def _unit_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "unit"):
            unit = slab.column("unit").to_numpy()
            first = np.concatenate(([True], unit[1:] != unit[:-1]))
            group, sizes = np.cumsum(first) - 1, np.diff(np.append(np.flatnonzero(first), len(unit)))
            several = (sizes > 1)[group]
            group = group[several]
            value = slab.column("fingerprint").to_numpy()[several].view("<u8")
            tree = slab.column("in_tree").to_numpy(zero_copy_only=False)[several]
            # visits of a search are at most the square of its unit's rows: several units at once only up to a bound
            work = np.cumsum((sizes.astype(np.int64) ** 2)[np.unique(group)]) // (SHARD * SHARD * 2)
            step = work[np.unique(group, return_inverse=True)[1]] if len(group) else group
            for s in np.unique(step):
                part = np.flatnonzero(step == s)
                a, b = bk_links(group[part], value[part], tree[part], radius)
                root = local_roots(len(part), a, b)
                linked = np.flatnonzero(root != np.arange(len(part)))
                v = value[part].view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(v[linked]), pa.array(v[root[linked]])], names=["a", "b"])

    return run


def fingerprint_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links whose components are those of all pairs of fingerprints at most radius bits apart.

    prints has a long column `fingerprint` of different values. Within a unit the links are
    reduced to one per fingerprint, to the first one reachable, which keeps the components.
    """
    units = _shards(prints.select("fingerprint"), radius)
    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(_unit_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs.

    docs needs doc_id and text; other columns are not read. A null or wordless text has the
    fingerprint zero and is linked like any other. Repeated rows each get their row. A null
    doc_id takes part in links, but is never a component_id unless the whole component has
    null ids. An empty table gives an empty table.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), "text", shingle, seed), "prints")
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    linked = components(fingerprint_links(least, radius), "a", "b")
    rooted = linked.join(least, linked.node == least.fingerprint).select("fingerprint", "root", "least_id")
    tops = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    joined = rooted.join(tops, "root").select("fingerprint", "component_id")
    final = least.join(joined, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least_id").alias("component_id")
    )
    return prints.join(stored(final, "components"), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _signed(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """docs (doc_id, hash, text) with class (high, low), words, fingerprint and band keys (none without words) for text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                numbers, hashes, some = [], [], []
                for i, x in enumerate(part.column("text")):
                    words = lowered_words(x.as_py())
                    numbers.append((*digest(words), len(words), fingerprint(x.as_py(), shingle, seed)))
                    if words:
                        some.append(i)
                        hashes.append(shingle_hashes(word_hashes(words), shingle))
                columns = np.array(numbers, np.uint64).T.copy().view(np.int64)
                offsets = np.zeros(part.num_rows + 1, np.int32)
                offsets[np.array(some, np.int64) + 1] = BANDS
                keys = band_keys(hashes).view(np.int64).ravel() if hashes else np.empty(0, np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [*part.select(["doc_id", "hash"]).columns, *map(pa.array, columns), bands],
                    names=["doc_id", "hash", "high", "low", "words", "fingerprint", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, hash long, high long, low long, words long, fingerprint long, bands array<long>"
    return docs.select("doc_id", "hash", "text").mapInArrow(run, schema)


def verified_links(value: np.ndarray, sets: list[np.ndarray], radius: int, threshold: float) -> list[tuple[int, int]]:
    """Links that join whatever pairs join that are at most radius bits and at least threshold similar.

    A BK-tree over the fingerprints gives each text's neighbours; the Jaccard similarity of the
    sets decides among those that are not reached yet. A text is visited once, and nothing is
    searched when all are reached, so a group of near copies costs little more than its size.
    """
    different, node = np.unique(value, return_inverse=True)
    group = np.zeros(len(different), np.int64)
    levels = bk_trees(group, different, np.ones(len(different), bool))
    sizes = np.array([len(s) for s in sets])
    begin = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    seen, links = np.zeros(len(values), bool), []
    open_ = np.ones(len(value), bool)
    for first in range(len(value)):
        queue = [first] if open_[first] else []
        open_[first] = False
        while queue and open_.any():
            me = queue.pop()
            near = np.zeros(len(different), bool)
            near[bk_search(levels, group, different, node[me : me + 1], radius)[1]] = near[node[me]] = True
            others = np.flatnonzero(open_ & near[node])
            if not len(others):
                continue
            many = sizes[others]
            start = np.cumsum(many) - many
            seen[flat[begin[me] : begin[me] + sizes[me]]] = True
            shared = np.add.reduceat(seen[flat[np.repeat(begin[others] - start, many) + np.arange(many.sum())]], start, dtype=np.int64)
            seen[flat[begin[me] : begin[me] + sizes[me]]] = False
            found = others[shared >= threshold * (many + sizes[me] - shared)].tolist()
            links += [(me, x) for x in found]
            open_[found] = False
            queue += found
    return links


def _text_links(radius: int, shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "unit"):
            unit, value = slab.column("unit").to_numpy(), slab.column("fingerprint").to_numpy().view("<u8")
            names, texts = slab.column("node").to_pylist(), slab.column("text")
            cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            for s, e in zip(cuts, [*cuts[1:], len(unit)]):
                if e - s > 1:
                    sets = [np.unique(shingle_hashes(word_hashes(lowered_words(x.as_py())), shingle)) for x in texts[s:e]]
                    links = [(names[s + a], names[s + b]) for a, b in verified_links(value[s:e], sets, radius, threshold)]
                    a, b = zip(*links) if links else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return run


def kept_documents(docs: DataFrame, radius: int = 22, shingle: int = 5, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, hash): the first document, by doc_id, of each group of near-duplicates; null ids come last.

    docs has doc_id, text and hash, the 64-bit hash of text. Two texts are linked if their
    fingerprints differ in at most radius bits and their sets of word shingles have a Jaccard
    similarity of threshold or more. At that radius one fingerprint finds nearly all, so the
    shards of the BK-trees cannot be blocks of its bits, as those of simhash_components: the
    bits of a block short enough would be shared by nearly all texts. They are the buckets of
    MinHash bands of the same shingles. At 0.8 fingerprints of unlike shingles differ in some
    10 of 64 bits with a deviation of 3, so a radius of 22 loses one pair in 10,000, and the
    bands lose two in 1000.
    """
    found = stored(_signed(docs, shingle, seed), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = F.min(F.struct(place.alias("first"), "words", "fingerprint", "bands")).alias("c")
    classes = stored(found.groupBy("high", "low").agg(first).select("high", "low", "c.*"), "classes")
    met = units(classes)
    wanted = classes.join(met.select("high", "low").distinct(), ["high", "low"], "left_semi")
    wanted = wanted.select(F.col("first.doc_id").alias("_i"), F.col("first.hash").alias("_h"), "high", "low", "fingerprint")
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted._i) & (docs.hash == wanted._h)).select("high", "low", "fingerprint", "text")
    texts = stored(texts.dropDuplicates(["high", "low"]), "texts")
    dealt = met.join(texts, ["high", "low"]).select("unit", name(), "fingerprint", "text").repartition("unit").sortWithinPartitions("unit")
    groups = components(dealt.mapInArrow(_text_links(radius, shingle, threshold), "a string, b string"), "a", "b")
    discard(found, met, texts)
    groups = groups.withColumnRenamed("node", "_node")
    rooted = classes.select(name(), "first").join(groups, F.col("node") == F.col("_node"), "left")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = stored(kept.select("first.doc_id", "first.hash"), "kept")
    discard(classes)
    return kept


def drop_near_duplicates(docs: DataFrame, radius: int = 22, shingle: int = 5, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """docs without the near-duplicates: the document with the smallest doc_id of each group stays.

    Rows are told apart by doc_id and text: those that share both, or all null and wordless
    texts, are copies of each other, while texts that are not alike all stay whatever their ids.
    All columns are kept.
    """
    keep = kept_documents(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), radius, shingle, threshold, seed)
    keep = keep.select(F.col("doc_id").alias("_kept_id"), F.col("hash").alias("_kept_hash"))
    rows = docs.select(packed(docs).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = rows.join(keep, rows._id.eqNullSafe(keep._kept_id) & (rows._hash == keep._kept_hash)).dropDuplicates(["_kept_id", "_kept_hash"])
    return kept.select(*unpacked(kept, "_row"))
