"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte that lies in a string of `length` bytes that also starts elsewhere is removed. Spark
brings together the suffixes that could be equal:

1. Each string's anchor is the least of its first WINDOW k-mers by a hash (leftmost among
   equals), so equal strings have their anchors at the same place, and the bytes from the
   anchor to the first string's possible end, the context, are equal too. Strings that start
   in a run of places share an anchor; there is one row for each run, not for each byte.
2. Contexts that occur once hold no repeated string. Copies of a whole run are folded into one
   class by 128 bits of hash over their bytes and the anchor's place: hashing alone, not the
   sort, decides that the runs of such a class are repeated whole, as most bytes of long copies
   are. What is left are runs with a repeated context that occur once, at the edges of repeated
   passages, and one example of each repeated run that such a run can meet; the sort decides them.
3. These runs' suffixes are sorted, a bucket (all runs with one context) at a time. A block of
   buckets holds the names of all `length` - 48-byte strings at the places of a difference cover
   modulo V (Burkhardt and Kärkkäinen 2003), got by doubling on the cover alone; suffixes
   that agree in their first V bytes and in their last are told apart by the names at the
   offset that brings both to the cover. Memory is that of one block.
4. A bucket of more than BUCKET runs is first cut by longer shared prefixes: its starts are
   split by their distance from the anchor, and runs are dealt again by the bytes that all
   strings of such a part share, until every bucket is small or all its strings are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.llm.common import discard, packed, slabs, sliced, stored

#: Bytes of a k-mer, and the modulus of the difference cover.
K, V = 8, 32
#: Runs of a bucket that is sorted as it is, and bytes of a block of buckets. A block's sort takes over a hundred times its bytes.
BUCKET, BLOCK_BYTES = 512, 1_000_000
#: Bytes that are scanned together, which take some seventy times that, and the bits that hold a place among them.
_STEP, _PLACE_BITS = 1 << 18, 26
#: Rows of a batch whose texts, or their parts, are Python objects at a time.
_ROWS = 512
#: Distances from the anchor that one part of a large bucket spans, step by step.
_GRAINS = (32, 4, 1)


def difference_cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """(cover, delta): every two residues i, j have i + delta[i, j] and j + delta[i, j] in the cover modulo v."""
    cover, missing = [0, 1], set(range(2, v - 1))
    while missing:
        gain = lambda c: len({(c - d) % v for d in cover} & missing) + len({(d - c) % v for d in cover} & missing)
        best = max((c for c in range(v) if c not in cover), key=gain)
        cover.append(best)
        missing -= {(a - b) % v for a in cover for b in cover}
    inside = np.isin(np.arange(2 * v) % v, cover)
    delta = np.array([[next(d for d in range(v) if inside[i + d] and inside[j + d]) for j in range(v)] for i in range(v)])
    return np.array(sorted(cover)), delta


_COVER, _DELTA = difference_cover(V)


def window_of(length: int) -> int:
    """k-mers among which a string's anchor is chosen."""
    return length * 16 // 25


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the runs of string starts that share an anchor, for texts data[starts:ends]."""
    window, n = window_of(length), len(data)
    padded = np.concatenate([data, np.zeros(K, np.uint8)])
    grams = np.ndarray((n,), "<u8", padded, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    low = np.uint64(_PLACE_BITS)
    keyed = (grams >> low << low) | np.arange(n, dtype=np.uint64)
    blocks = np.concatenate([keyed, np.full(-n % window + window, np.uint64(2**64 - 1))]).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & np.uint64((1 << _PLACE_BITS) - 1)
    step = np.zeros(n + 1, np.int8)
    whole = ends - starts >= length
    np.add.at(step, starts[whole], 1)
    np.add.at(step, ends[whole] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(step[:n]))
    if not len(at):
        return at, at, at
    anchor = least[at].astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    cut = np.flatnonzero(new)
    return anchor[cut], at[cut], at[np.append(cut[1:], len(at)) - 1]


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray, np.ndarray]]:
    """((row, place of the piece in its text) of each piece, bytes, starts, ends), at most 2 * _STEP bytes at a time.

    A text of more than _STEP bytes comes in pieces that overlap by length - 1 bytes.
    """
    rows, held, size = [], [], 0

    def out():
        ends = np.cumsum([len(x) for x in held])
        return rows, b"".join(held), ends - [len(x) for x in held], ends

    for i, x in enumerate(batch.column("text")):
        data = (x.as_py() or "").encode("utf-8", "surrogatepass")
        if len(data) < length:
            continue
        for s in range(0, len(data) - length + 1, _STEP):
            piece = data[s : s + _STEP + length - 1]
            if held and size + len(piece) > 2 * _STEP:
                yield out()
                rows, held, size = [], [], 0
            rows.append((i, s))
            held.append(piece)
            size += len(piece)
    if held:
        yield out()


_ANCHORS = "doc_id {id}, hash long, anchor long, first long, last long, context long, run long, run_low long"


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row for each run of string starts: its document, places, and hashes of its context and of itself."""
    reach = length - window_of(length) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, digest_128, half = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest, 2**64 - 1
        for b in batches:
            for rows, data, starts, ends in _pieces(b, length):
                anchor, first, last = runs_of(np.frombuffer(data, np.uint8), starts, ends, length)
                places = zip(anchor.tolist(), first.tolist(), last.tolist())
                whole = [(digest(data[a : a + reach]), digest_128(data[f : e + length], a - f)) for a, f, e in places]
                hashes = np.array([(c, r >> 64, r & half) for c, r in whole], np.uint64).reshape(-1, 3).T.copy().view(np.int64)
                piece = np.searchsorted(ends, first, side="right")
                row, base = (np.array(c, np.int64)[piece] for c in zip(*rows))
                shift = base - starts[piece]
                own = b.select(["doc_id", "hash"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *(pa.array(x) for x in (anchor + shift, first + shift, last + shift, *hashes))],
                    names=["doc_id", "hash", "anchor", "first", "last", "context", "run", "run_low"],
                )

    return docs.select("doc_id", "hash", "text").mapInArrow(scan, _ANCHORS.format(id=_id(docs)))


def _id(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's runs (doc_id, hash, bucket, anchor, first, last) with their bytes, through one join with docs."""
    lists = wanted.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("bucket", "anchor", "first", "last")).alias("runs"))
    lists = lists.withColumnsRenamed({"doc_id": "_i", "hash": "_h"})
    both = docs.join(lists, docs.doc_id.eqNullSafe(lists._i) & (docs.hash == lists._h))
    return both.select("doc_id", "hash", F.col("text").cast("binary").alias("data"), F.explode("runs").alias("r")).select(
        "doc_id", "hash", "r.bucket", "r.anchor", "r.first", "r.last", "data"
    )


def _cut(regions: DataFrame, length: int) -> DataFrame:
    return regions.withColumn("data", F.expr(f"substring(data, int(first + 1), int(last - first + {length}))"))


def sort_block(data: bytes, sizes: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the block's suffixes are equal, over `length` bytes, to another of their bucket.

    data holds regions of the given sizes, one after another; a region's suffixes are those with
    `length` bytes left in it. The result has an entry for each suffix, in order.
    """
    text = np.frombuffer(data + b"\0" * (length + K), np.uint8)
    words = np.ndarray((len(text) - K + 1,), ">u8", text, strides=(1,))
    begin = np.cumsum(sizes) - sizes
    many = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[owner]
    head = [words[at + k].astype(np.uint64) for k in range(0, V, K)]
    order = np.lexsort([*head[::-1], bucket[owner]])
    new = _new([bucket[owner], *head], order)
    order, group = _ties(order, new)
    repeated = np.zeros(len(at), bool)
    if not len(order):
        return repeated
    deep = (length - V) // V * V
    tail = [words[at[order] + k].astype(np.uint64) for k in [*range(deep, length - K, K), length - K]]
    again = np.lexsort([*tail[::-1], group])
    new = _new([group, *tail], again)
    kept, group = _ties(again, new)
    if not len(kept):
        return repeated
    order = order[kept]
    names = _cover_names(words, at, owner[order], begin, sizes, deep)
    while len(order):
        first = np.concatenate(([True], group[1:] != group[:-1]))
        pivot = at[order[first]][np.cumsum(first) - 1]
        mine = at[order]
        delta = _DELTA[pivot % V, mine % V]
        same = names[pivot + delta] == names[mine + delta]
        several = np.bincount(np.cumsum(first) - 1, weights=same)[np.cumsum(first) - 1] > 1
        repeated[order[same & several]] = True
        order, group = order[~same], group[~same]
    return repeated


def _new(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where, in sorted order, a key differs from the one before."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for k in keys:
        s = k[order]
        out[1:] |= s[1:] != s[:-1]
    return out


def _ties(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is not alone in its group, with group numbers."""
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(group) else new
    return order[several], group[several]


def _cover_names(words: np.ndarray, at: np.ndarray, used: np.ndarray, begin: np.ndarray, sizes: np.ndarray, deep: int) -> np.ndarray:
    """By place, on the cover within the used regions: the name (rank) of the `deep` bytes that start there."""
    regions = np.unique(used)
    many = sizes[regions]
    places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[regions], many)
    cover = places[np.isin(places % V, _COVER)]
    names = np.zeros(len(words) + 2 * deep, np.int64)
    parts = [words[cover + k].astype(np.uint64) for k in range(0, V, K)]
    order = np.lexsort(parts[::-1])
    names[cover[order]] = np.cumsum(_new(parts, order))
    span = V
    while span < deep:
        step = min(span, deep - span)
        pair = names[cover] << 32 | names[cover + step]
        names[cover] = np.unique(pair, return_inverse=True)[1] + 1
        span += step
    return names


def _sorted_spans(length: int, id_type: str):
    """A task over runs sorted by bucket: spans of repeated bytes, a block of buckets at a time."""

    def block(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        data = t.column("data").to_pylist()
        sizes = np.array([len(x) for x in data], np.int64)
        marks = sort_block(b"".join(data), sizes, np.unique(t.column("bucket").to_numpy(), return_inverse=True)[1], length)
        many = sizes - length + 1
        owner = np.repeat(np.arange(len(sizes)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + t.column("first").to_numpy()[owner]
        hit = np.flatnonzero(marks)
        return spans(t.select(["doc_id", "hash"]), owner[hit], place[hit])

    def spans(own: pa.Table, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)))[: len(owner)]
        cut = np.flatnonzero(new)
        last = place[np.append(cut[1:], len(owner)) - 1] if len(cut) else place
        rows = own.take(pa.array(owner[cut])).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(place[cut]), pa.array(last + length)], names=["doc_id", "hash", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for slab in slabs(batches, "bucket"):
            # a slab is a whole batch of many buckets: it is cut between them
            bucket, ends = slab.column("bucket").to_numpy(), np.cumsum(pc.binary_length(slab.column("data")).to_numpy())
            at = 0
            for cut in [*np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]:
                more = int(ends[cut - 1] - (ends[at - 1] if at else 0))
                if size + more > BLOCK_BYTES or cut == len(bucket):
                    held.append(slab.slice(at, cut - at))
                    size, at = size + more, cut
                if size > BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return run


def _parted(grain: int, length: int):
    """A task that cuts runs of large buckets by distance from the anchor, grain by grain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, digest_128, half = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest, 2**64 - 1
        for b in sliced(batches, _ROWS):
            rows, keys, firsts, lasts, runs, lows, data = [], [], [], [], [], [], []
            lists = (b.column(c).to_pylist() for c in ("bucket", "anchor", "first", "last", "data"))
            for i, (bucket, anchor, first, last, body) in enumerate(zip(*lists)):
                for j in range((anchor - last) // grain, (anchor - first) // grain + 1):
                    top, bottom = anchor - j * grain, anchor - j * grain - grain + 1
                    low, high = max(first, bottom), min(last, top)
                    core = body[top - first : bottom + length - first]
                    part = body[low - first : high + length - first]
                    rows.append(i)
                    keys.append(digest(core, (bucket ^ (j * 0x9E3779B97F4A7C15)) & (2**64 - 1)))
                    whole = digest_128(part, low - bottom)
                    runs.append(whole >> 64)
                    lows.append(whole & half)
                    firsts.append(low)
                    lasts.append(high)
                    data.append(part)
            own = b.select(["doc_id", "hash", "anchor"]).take(pa.array(rows, pa.int64()))
            hashes = [np.array(x, np.uint64).view(np.int64) for x in (keys, runs, lows)]
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), *map(pa.array, hashes), pa.array(data, pa.binary())],
                names=["doc_id", "hash", "anchor", "first", "last", "bucket", "run", "run_low", "data"],
            )

    return run


def _examples(runs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(repeated, open, tables): all rows of runs that occur whole more than once, the rows that have to be sorted, and what to discard.

    runs has bucket, run and run_low; open has every run that occurs once in a bucket of several
    rows, and one row of each repeated run of such a bucket.
    """
    place, run = F.xxhash64("doc_id", "hash", "first"), ["bucket", "run", "run_low"]
    sums = stored(runs.groupBy(*run).agg(F.count("*").alias("n"), F.min(place).alias("pick")), "runs")
    rows = runs.join(sums, run)
    bucket = sums.groupBy("bucket").agg(F.min("n").alias("least"), F.sum("n").alias("rows"))
    # a table, so that adaptive execution can split the join's hot buckets
    opened = stored(bucket.where("least = 1 and rows > 1").select("bucket"), "opened")
    picked = rows.where(place == F.col("pick")).join(opened, "bucket", "left_semi")
    return rows.where("n > 1"), picked.drop("n", "pick"), [sums, opened]


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, hash, start, end): byte spans, overlapping or not, that cover exactly what is repeated.

    docs has doc_id, text and hash, the 64-bit hash of text.
    """
    if length < 4 * V:
        raise ValueError(f"strings of at least {4 * V} bytes are supported, not {length}")
    ids = _id(docs)
    span = lambda df: df.select("doc_id", "hash", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    anchors = stored(_anchors(docs, length).withColumnRenamed("context", "bucket"), "anchors")
    several = stored(anchors.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "several")
    live = stored(anchors.join(several, "bucket", "left_semi"), "live")
    discard(anchors, several)
    whole, opened, tables = _examples(live)
    out = stored(span(whole), "spans")
    regions = stored(_cut(_regions(docs, opened), length), "regions")
    discard(live, *tables)
    schema = f"doc_id {ids}, hash long, start long, end long"
    for grain in (*_GRAINS, None):
        large = stored(regions.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("bucket"), "large")
        hot = grain is not None and large.count() > 0
        ready = regions.join(large, "bucket", "left_anti") if hot else regions
        dealt = ready.repartition("bucket").sortWithinPartitions("bucket")
        out = out.union(stored(dealt.mapInArrow(_sorted_spans(length, ids), schema), "spans"))
        if not hot:
            discard(regions, large)
            break
        cut = regions.join(large, "bucket", "left_semi").select("doc_id", "hash", "bucket", "anchor", "first", "last", "data")
        parts = f"doc_id {ids}, hash long, anchor long, first long, last long, bucket long, run long, run_low long, data binary"
        parted = stored(cut.mapInArrow(_parted(grain, length), parts), "parts")
        discard(regions, large)
        whole, opened, tables = _examples(parted)
        out = out.union(stored(span(whole), "spans"))
        regions = stored(opened, "regions")
        discard(parted, *tables)
    return out


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs' other columns than text, n_bytes, n_removed, n_spans and kept (binary) for every row.

    docs needs doc_id and text. Every byte of the UTF-8 text that is covered by a string of
    `length` bytes that also starts elsewhere, in the same text or another, is removed; matches
    never cross texts, and strings are judged on the input. n_spans counts maximal removed
    stretches. kept is binary, since a cut can fall inside a character. A null text counts as
    empty; repeated rows are copies of each other, so what is long enough goes from all. Columns
    with these names are replaced.
    """
    added = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    spans = repeated_spans(keyed.where(F.octet_length("text") >= length), length)
    lists = spans.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    lists = lists.withColumnsRenamed({"doc_id": "_i", "hash": "_h"})
    rest = [c for c in docs.columns if c != "text" and c not in dict(added)]
    hashed = docs.select(packed(docs, "text", *dict(added)).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    both = hashed.join(lists, hashed.doc_id.eqNullSafe(lists._i) & (hashed._hash == lists._h), "left").select("_row", "text", "_spans")
    out = T.StructType([docs.schema[c] for c in rest])
    for n, kind in added:
        out = out.add(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, _ROWS):
            counts, texts = [], []
            for x, found in zip(b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("_spans")).to_pylist()):
                data = (x.as_py() or "").encode("utf-8", "surrogatepass")
                kept, removed, stretches, at = [], 0, 0, 0
                for s, e in merged([(r["start"], r["end"]) for r in found or ()]):
                    kept.append(data[at:s])
                    removed, stretches, at = removed + e - s, stretches + 1, e
                kept.append(data[at:])
                counts.append((len(data), removed, stretches))
                texts.append(b"".join(kept))
            row = b.column(b.schema.get_field_index("_row"))
            own = [row.field(i) for i in range(1, len(rest) + 1)]
            numbers = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in numbers), pa.array(texts, pa.binary())], names=[*rest, *dict(added)])

    return both.mapInArrow(run, out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches that the spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
