"""Documents that hold benchmark passages, by q-gram lemma filtering and banded alignment.

Texts are compared as UTF-8 bytes with A-Z lowered and white space collapsed. A benchmark item
is matched whole if it is short, else by segments of SEGMENT bytes, so a document that holds
part of an item is found too. If a segment of m bytes occurs with at most k edits, it shares
at least m + 1 - q (k + 1) of its q-grams with the text, on diagonals that differ by at most k
(the q-gram lemma; Rasmussen, Stoye and Myers 2006). q is Q, or less for short items, so that
the bound is never below one. Windows of the text that share too few q-grams, counted by kind,
go first. In what is left, shared q-grams are counted in diagonal bands of width 2k that overlap
by k, so that every such match lies whole in one band; bands that reach the bound are verified
by an alignment restricted to their diagonals.

The benchmark is a stated query set. It is shipped to tasks in blocks of a bounded number of
bytes; documents are read once for each block. Texts are searched in pieces of some _STEP bytes
that overlap by more than a match, and q-grams are expanded _ROWS at a time, so memory follows
neither the length of a text nor its repetitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.llm.common import packed, unpacked

#: Most bytes of a q-gram; a q-gram is looked up as one 64-bit number.
Q = 8
#: Bytes of a segment, and of the benchmark text that one block ships.
SEGMENT, BLOCK_BYTES = 120, 8_000_000
#: Bytes of texts that are looked up together, rows of an expansion, and what makes diagonals positive.
_STEP, _ROWS, _SHIFT = 1 << 20, 1 << 19, 1 << 33
#: Shared places of a segment and a window from which on aligning them whole is cheaper than counting bands.
_DENSE = 4096


def normal(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8").lower().split()) if text else b""


def _grams(data: bytes, q: int = Q) -> np.ndarray:
    """All q-grams of data as numbers, in order."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    out = np.ndarray((max(0, len(data) - q + 1),), "<u8", padded, strides=(1,)).copy()
    return out & np.uint64((1 << 8 * q) - 1) if q < 8 else out


@dataclass(frozen=True)
class Segment:
    """A piece of an item: its bytes and its edit budget."""

    item: int
    data: bytes
    budget: int

    @property
    def q(self) -> int:
        return min(Q, len(self.data) // (self.budget + 1))

    @property
    def least(self) -> int:
        """The shared q-grams that the lemma asks for, at least one."""
        return len(self.data) + 1 - self.q * (self.budget + 1)


def segments(item: int, text: str | None, error: float) -> list[Segment]:
    """The whole of a short item, else pieces of SEGMENT bytes at every half of that, the last one at the end.

    The budget is error * length edits. An empty item has no segment.
    """
    data = normal(text)
    if not data:
        return []
    starts = [0] if len(data) <= SEGMENT else sorted({*range(0, len(data) - SEGMENT, SEGMENT // 2), len(data) - SEGMENT})
    pieces = (data[s : s + SEGMENT] for s in starts)
    return [Segment(item, x, min(int(error * len(x)), len(x) - 1)) for x in pieces]


class Index:
    """A block's segments: equal ones are one, those of one q share a table, and short ones are looked up as words."""

    def __init__(self, parts: list[Segment]):
        items: dict[tuple[bytes, int], list[int]] = {}
        for p in parts:
            items.setdefault((p.data, p.budget), []).append(p.item)
        self.items = {k: sorted(set(v)) for k, v in items.items()}
        self.words = {d: v for (d, _), v in self.items.items() if len(d) < Q}
        long = [Segment(v[0], d, k) for (d, k), v in self.items.items() if len(d) >= Q]
        self.tables = [Grams([p for p in long if p.q == q], q) for q in sorted({p.q for p in long})]
        self.gap = b"\n" * (4 * max((p.budget for p in parts), default=0) + Q + 1)
        self.reach = max((len(p.data) + p.budget for p in parts), default=0)


class Grams:
    """The q-grams of segments: a small table that turns most q-grams away, and sorted arrays."""

    def __init__(self, parts: list[Segment], q: int):
        self.parts, self.q = parts, q
        grams = [_grams(p.data, q) for p in parts]
        key = np.concatenate(grams)
        owner = np.repeat(np.arange(len(parts)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.place, sorted_owner = place[order], owner[order]
        self.key, number = np.unique(key[order], return_inverse=True)
        # kinds: the different (q-gram, segment), each with its places
        new = np.concatenate(([True], (number[1:] != number[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])))
        self.kind_first = np.flatnonzero(new)
        self.kind_many = np.diff(np.append(self.kind_first, len(key)))
        self.kind_owner = sorted_owner[new]
        self.first = np.searchsorted(number[new], np.arange(len(self.key)))
        self.many = np.bincount(number[new], minlength=len(self.key))
        self.bits = max(12, min(26, int(len(key)).bit_length() + 4))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.key)] = True
        self.budget = np.array([p.budget for p in parts], np.int64)
        self.width = np.maximum(self.budget, 1)
        self.least = np.array([p.least for p in parts], np.int64)
        self.window = max(len(p.data) + p.budget for p in parts)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def bands(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first diagonal, width) of the bands whose shared q-grams reach the segment's bound.

        A window that shares very many places with a segment, as repetitive texts do, is one wide band.
        """
        found = [(np.empty(0, np.int64),) * 3]
        grams = _grams(data, self.q)
        at = np.flatnonzero(self.table[self._slot(grams)])
        key = np.minimum(np.searchsorted(self.key, grams[at]), len(self.key) - 1)
        there = self.key[key] == grams[at]
        at, key = at[there], key[there]
        # a match lies whole in one of the windows, which overlap by half
        window = at // self.window
        many = np.bincount(window, minlength=len(data) // self.window + 2)
        full = many + np.append(many[1:], 0) >= self.least.min()
        at, key, window = np.tile(at, 2), np.tile(key, 2), np.concatenate([window, window - 1])
        inside = (window >= 0) & full[window]
        at, key, window = at[inside], key[inside], window[inside]
        order = np.argsort(window * len(self.key) + key, kind="stable")
        at, key, window = at[order], key[order], window[order]
        first = np.flatnonzero(_changes(window, key))
        many = np.diff(np.append(first, len(at)))
        for part in _bounded(window[first], self.many[key[first]]):
            found += self._candidates(at, window[first[part]], key[first[part]], first[part], many[part])
        owner, start, width = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
        return owner, start, width

    def _candidates(self, at: np.ndarray, window: np.ndarray, key: np.ndarray, first: np.ndarray, many: np.ndarray) -> list:
        """The bands of some windows; rows are their different q-grams, which have `many` places in `at` from first on."""
        row, kind = _spread(self.first[key], self.many[key])
        owner, times = self.kind_owner[kind], self.kind_many[kind]
        order = np.argsort(window[row] * len(self.parts) + owner, kind="stable")
        row, kind, owner, times = row[order], kind[order], owner[order], times[order]
        pair = np.cumsum(_changes(window[row], owner)) - 1
        shared = np.bincount(pair, weights=np.minimum(times, many[row])) if len(pair) else np.empty(0)
        enough = shared[pair] >= self.least[owner] if len(pair) else np.empty(0, bool)
        row, kind, owner, times, pair = row[enough], kind[enough], owner[enough], times[enough], pair[enough]
        if not len(pair):
            return []
        work = many[row] * times
        dense = np.bincount(pair, weights=work)[pair] > _DENSE
        one = np.flatnonzero(_changes(pair) & dense)
        start = window[row[one]] * self.window - self.budget[owner[one]]
        wide = [(owner[one], start, 2 * (self.window + self.budget[owner[one]]))]
        row, kind, owner, pair, work = row[~dense], kind[~dense], owner[~dense], pair[~dense], work[~dense]
        return wide + [self._banded(at, first[row[p]], many[row[p]], kind[p], owner[p], pair[p]) for p in _bounded(pair, work)]

    def _banded(self, at: np.ndarray, first: np.ndarray, many: np.ndarray, kind: np.ndarray, owner: np.ndarray, pair: np.ndarray) -> tuple:
        """Preserved q-grams are different ones of the segment and of the text, so both are counted."""
        row, text = _spread(first, many)
        again, place = _spread(self.kind_first[kind[row]], self.kind_many[kind[row]])
        text, place, row = at[text[again]], self.place[place], row[again]
        # every diagonal lies in two bands of width 2k: the one that starts at its multiple of k, and the one before
        band = (text - place + _SHIFT) // self.width[owner[row]]
        pair, owner, text, place = np.tile(pair[row], 2), np.tile(owner[row], 2), np.tile(text, 2), np.tile(place, 2)
        band = np.concatenate([band, band - 1])
        for by_place in (False, True):
            order = np.lexsort((place if by_place else text, band, pair))
            pair, owner, band, text, place = pair[order], owner[order], band[order], text[order], place[order]
            new = _changes(pair, band)
            different = new | _changes(place if by_place else text)
            number = np.cumsum(new) - 1
            enough = np.bincount(number, weights=different)[number] >= self.least[owner] if len(pair) else new
            pair, owner, band, text, place = pair[enough], owner[enough], band[enough], text[enough], place[enough]
        return owner, band * self.width[owner] - _SHIFT, 2 * self.width[owner]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row the places first .. first + many - 1."""
    row = np.repeat(np.arange(len(first)), many)
    return row, np.arange(len(row)) + (first - np.cumsum(many) + many)[row]


def _bounded(group: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows, sorted by group, that keep groups whole and have some _ROWS in sizes each."""
    if not len(group):
        return
    start = np.flatnonzero(_changes(group))
    before = np.concatenate(([0], np.cumsum(sizes)))[start]
    cuts = start[_changes(before // _ROWS)]
    for s, e in zip(cuts, [*cuts[1:], len(group)]):
        yield slice(int(s), int(e))


def banded_matches(
    pieces: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, budget: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best place of each of the pieces in text, on diagonals first .. first + width.

    pieces has a row of bytes for each candidate. Semi-global alignment, all candidates side by
    side, by columns of diagonals; text before and after a match is free, and ties go to the
    earliest end. Edits over the budget are given as budget + 1.
    """
    n, far = width + 1, budget + 1
    diagonals = np.arange(n)
    start = first[:, None] + diagonals
    cost = np.where((start >= 0) & (start <= len(text)), 0, far)
    padded = np.append(text, np.zeros(1, np.uint8))
    for i in range(pieces.shape[1]):
        at = first[:, None] + diagonals + i
        inside = (at >= 0) & (at < len(text))
        equal = padded[np.where(inside, at, len(text))] == pieces[:, i : i + 1]
        step, origin = np.where(inside, cost + ~equal, far), start
        # the piece's byte has no partner: from the next diagonal
        down = np.full_like(cost, far + 1)
        down[:, :-1] = cost[:, 1:] + 1
        lower = down < step
        step, origin = np.where(lower, down, step), np.where(lower, np.roll(start, -1, axis=1), origin)
        # a text byte has no partner: one step along the diagonals, costs plus distance
        run = step - diagonals
        best = np.minimum.accumulate(run, axis=1)
        source = np.maximum.accumulate(np.where(run == best, diagonals, 0), axis=1)
        cost, start = np.minimum(best + diagonals, far), np.take_along_axis(origin, source, axis=1)
    k = cost.argmin(axis=1)
    row = np.arange(len(pieces))
    return cost[row, k], start[row, k], first + k + pieces.shape[1]


def find_passages(docs: DataFrame, benchmark: DataFrame, error: float = 0.1) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where docs (doc_id, text) hold segments of benchmark (item_id, text).

    start and end are byte places in the normalised text. Overlapping places of an item are one,
    with the fewest edits of a segment. Items under Q bytes are found exactly and as whole words,
    since within words they would be in nearly every text. Null and empty texts match nothing; an
    item whose text occurs under two ids is found under both; repeated rows of docs each give
    their matches. Of equally good places of a segment in one band the one that ends first counts.
    """
    out = T.StructType(
        [docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]
    )
    schema = pa.schema([("doc_id", _arrow(out[0])), ("item_id", _arrow(out[1])), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
    found = docs.sparkSession.createDataFrame([], out)
    for ids, block in _blocks(benchmark, error):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, index = shipped.value[0], Index(shipped.value[1])
            for b in batches:
                rows = [(b.column("doc_id")[t].as_py(), ids[item], *rest) for t, item, *rest in places(map(normal, b.column("text").to_pylist()), index)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        found = found.union(docs.select("doc_id", "text").mapInArrow(run, out))
    return found


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def _blocks(benchmark: DataFrame, error: float) -> Iterator[tuple[list, list[Segment]]]:
    """The benchmark's segments in blocks of at most about BLOCK_BYTES bytes, streamed through the driver one by one."""
    ids, block, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        own = segments(len(ids), row["text"], error)
        ids.append(row["item_id"])
        block += own
        size += sum(len(s.data) for s in own)
        if size >= BLOCK_BYTES:
            yield ids, block
            ids, block, size = [], [], 0
    if block:
        yield ids, block


def places(texts: Iterator[bytes] | list[bytes], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every item that a normalised text holds, overlapping places merged.

    Texts are searched together, apart by more bytes than any budget bridges; long ones in pieces.
    """
    held: list[tuple[int, int, bytes]] = []
    size, hits = 0, {}
    for t, text in enumerate(texts):
        for item, s, e in _as_words(text, index.words):
            hits.setdefault((t, item), []).append((s, e, 0))
        for base in range(0, max(len(text) - index.reach, 0) + 1, _STEP):
            held.append((t, base, text[base : base + _STEP + index.reach]))
            size += len(held[-1][2])
            if size > _STEP:
                _search(held, index, hits)
                held, size = [], 0
    _search(held, index, hits)
    for (t, item), found in sorted(hits.items()):
        found.sort()
        start, end, edits = found[0]
        for s, e, d in found[1:]:
            if s <= end:
                end, edits = max(end, e), min(edits, d)
            else:
                yield t, item, start, end, edits
                start, end, edits = s, e, d
        yield t, item, start, end, edits


def _as_words(text: bytes, short: dict[bytes, list[int]]) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the items under Q bytes that stand in text as whole words."""
    if not short:
        return
    cuts = [-1, *(i for i, c in enumerate(text) if c == 32), len(text)]
    for i, cut in enumerate(cuts[:-1]):
        for end in cuts[i + 1 : i + 1 + Q]:
            if end - cut > Q:
                break
            for item in short.get(text[cut + 1 : end], ()):
                yield item, cut + 1, end


def _search(held: list[tuple[int, int, bytes]], index: Index, hits: dict) -> None:
    """Add to hits what the pieces (text, place in it, bytes) hold."""
    if not held:
        return
    begin = np.cumsum([0, *(len(x) + len(index.gap) for _, _, x in held)])[:-1]
    data = index.gap.join(x for _, _, x in held)
    body = np.frombuffer(data, np.uint8)
    for table in index.tables:
        part, first, width = table.bands(data)
        kinds = np.array([len(p.data) << 32 | p.budget for p in table.parts], np.int64)[part]
        for kind, wide in sorted(set(zip(kinds.tolist(), width.tolist()))):
            budget, same = kind & 0xFFFFFFFF, np.flatnonzero((kinds == kind) & (width == wide))
            for own in np.array_split(same, len(same) * wide // 100_000 + 1):
                pieces = np.stack([np.frombuffer(table.parts[p].data, np.uint8) for p in part[own]])
                edits, start, end = banded_matches(pieces, body, first[own], wide, budget)
                for i in np.flatnonzero(edits <= budget):
                    # a text cut at the front may be aligned with bytes of the gap before it, so the end tells the text
                    k = int(np.searchsorted(begin, end[i] - 1, side="right")) - 1
                    text, base, piece = held[k]
                    s, e = max(int(start[i] - begin[k]), 0), min(int(end[i] - begin[k]), len(piece))
                    for item in index.items[table.parts[part[own[i]]].data, budget]:
                        hits.setdefault((text, item), []).append((base + s, base + e, int(edits[i])))


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = 0.1) -> DataFrame:
    """One row for each document (doc_id) that holds a passage: n_items, n_bytes covered, fewest edits.

    Rows that share a doc_id, or have none, are judged each by itself and reported as one.
    """
    found = find_passages(docs, benchmark, error).distinct()
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.sum(F.col("end") - F.col("start")).alias("n_bytes"),
        F.min("edits").alias("edits"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, error: float = 0.1) -> DataFrame:
    """docs without the rows that hold a benchmark passage; all columns are kept.

    Every row is judged by its own text, whatever its doc_id, in place: nothing is shuffled.
    """
    for ids, block in _blocks(benchmark, error):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = Index(shipped.value)
            for b in batches:
                texts = b.column(b.schema.get_field_index("_text")).to_pylist()
                clean = np.ones(b.num_rows, bool)
                clean[[t for t, *_ in places(map(normal, texts), index)]] = False
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_row")).filter(pa.array(clean))], names=["_row"])

        rows = docs.select(packed(docs).alias("_row"), F.col("text").alias("_text"))
        told = rows.mapInArrow(run, T.StructType([rows.schema["_row"]]))
        docs = told.select(*unpacked(told, "_row"))
    return docs
