"""Documents to parent and child chunks. Splitting is a fold over one text, so it is a small Python
function in an Arrow batch; everything around it (exploding, hashing, parents, pages) is DataFrame work."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.functions import fixed
from ravine.functions import text as tx


#: Bytes of text that a worker holds as Python objects at a time, with the chunks made of it.
HELD = 1 << 20


def _size(text: str) -> int:
    return len(text) // 4


def _few(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text, one long text at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        starts = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if len(part) else []
        for start, end in zip(starts, [*starts[1:], len(part)]):
            yield b.slice(start, end - start)


def split_text(text: str, size: int = 800, overlap: int = 100, separators: list[str] | None = None) -> list[str]:
    """Chunks of about `size` estimated tokens, cut at the coarsest separators that do.

    A separator stays at the end of its piece. Pieces are packed greedily, and a chunk begins
    with the last whole pieces of the one before, up to `overlap` tokens. A text without any
    separator is cut by characters, and ends at its end.
    """
    separators = fixed.MARKDOWN_SEPARATORS + fixed.SEPARATORS if separators is None else separators
    if _size(text) <= size:
        return [text] if text else []
    level = next((i for i, s in enumerate(separators) if s in text.rstrip(s) or text.count(s) > 1), None)
    if level is None:
        width, step = size * 4, max(1, (size - overlap) * 4)
        last = max(0, len(text) - width)
        return [text[i : i + width] for i in [*range(0, last, step), last]]
    parts = text.split(separators[level])
    pieces = [p + separators[level] for p in parts[:-1]] + parts[-1:]
    finer = separators[level + 1 :]
    packed: list[list[str]] = [[]]
    held = 0
    for piece in (q for p in pieces if p for q in (split_text(p, size, overlap, finer) if _size(p) > size else [p])):
        if packed[-1] and held + _size(piece) > size:
            kept, room = [], overlap
            for back in reversed(packed[-1]):
                room -= _size(back)
                if room < 0:
                    break
                kept.append(back)
            packed.append(kept[::-1])
            held = sum(map(_size, kept))
        packed[-1].append(piece)
        held += _size(piece)
    return ["".join(c) for c in packed if c]


_HEADING = re.compile(r"(?m)^#{1,6}[ \t]+(.+)$")
_TABLE = re.compile(r"(?:\|[^\n]+\|\n)+")


def split_keeping_tables(text: str, size: int = 800, overlap: int = 100) -> list[str]:
    """Like split_text(), but no Markdown table is cut: while the text is split, a sign that holds no separator stands for it."""
    if "|" not in text:
        return split_text(text, size, overlap)
    # a private-use character that the text does not hold; 137,000 of them
    sign = next(c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))) if c not in text)
    tables: list[str] = []

    def held(m: re.Match) -> str:
        tables.append(m[0])
        return f"{sign}{len(tables) - 1}{sign}"

    signs = _TABLE.sub(held, text)
    back = lambda c: re.sub(f"{sign}(\\d+){sign}", lambda m: tables[int(m[1])], c) if sign in c else c
    return [back(c) for c in split_text(signs, size, overlap)]


def reference(key: Column) -> Column:
    """A Markdown table of one row that stands for a long one kept elsewhere: no text is cut in a table, so the cuts are the same."""
    return F.concat(F.lit("| table "), key.cast("string"), F.lit(" |"))


def put_back(text: Column, key: Column, table: Column) -> Column:
    """text with the table, without its last line end, in the place of its reference; the text may hold no such row of its own."""
    # parts joined by the table: replace() would reserve sixteen times the table for each row
    parts = F.split(text, F.concat(F.lit("\\Q"), reference(key), F.lit("\\E")))
    return F.call_function("array_join", parts, table)


def pack_words(text: str, most: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Chunks of at most `most` estimated tokens; separators go at chunk edges and pieces are trimmed.

    What no separator cuts is cut by characters (C7).
    """
    text = text.strip()
    if _size(text) <= most:
        return [text] if text else []
    for n, s in enumerate(separators):
        if s in text:
            out, now = [], ""
            for piece in filter(None, (p.strip() for p in text.split(s))):
                joined = now + s + piece if now else piece
                if _size(joined) <= most:
                    now = joined
                    continue
                out += [now] if now else []
                fine = pack_words(piece, most, separators[n + 1 :]) if _size(piece) > most else [piece]
                out, now = (out + fine, "") if len(fine) != 1 else (out, fine[0])
            return out + ([now] if now else [])
    return [text[i : i + most * 4] for i in range(0, len(text), most * 4)]


def with_overlap(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk behind the last `overlap` estimated tokens of the one before, overlap included."""
    out: list[str] = []
    for c in chunks:
        tail = out[-1][-overlap * 4 :] + " " if out and overlap > 0 and _size(out[-1]) > overlap else ""
        out.append(tail + c)
    return out


def window_chunks(text: str, size: int = 1000, overlap: int = 200, least: int = 100) -> list[str]:
    """Windows of `size` characters that end at a sentence if one ends in the last fifth."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            base = at + int(size * 0.8)
            stops = [m.end() for m in re.finditer(r"[.!?]\s+", text[base:end])]
            end = base + stops[-1] if stops else end
        if len(piece := text[at:end].strip()) >= least:
            out.append(piece)
        if end >= len(text):
            break
        at = end - overlap
    return out


def _nested(docs: DataFrame, parent: int, parent_overlap: int, child: tuple[int, int] | None) -> DataFrame:
    """(document_id, parents): each parent's text, place, (J18) the last Markdown heading that begins at or before it, and its children of that size and overlap, if asked for."""
    kind = docs.schema["document_id"].dataType.simpleString()
    children = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64())]))
    parents = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64()), ("heading", pa.string()), *([("children", children)] if child else [])]))

    def located(whole: str, pieces: list[str]) -> list[tuple[str, int]]:
        """Trimmed pieces with their places; a piece is looked for from where the one before begins."""
        out, at = [], 0
        for p in filter(None, (x.strip() for x in pieces)):
            at = max(at, whole.find(p, at))
            out.append((p, at))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows = []
            for x in b.column("text"):
                text = x.as_py() or ""
                found = located(text, split_keeping_tables(text, parent, parent_overlap))
                heads = [(m.start(), m[1].strip(" ")) for m in _HEADING.finditer(text)]
                above = lambda s: heads[n - 1][1] if (n := bisect_right(heads, s, key=lambda h: h[0])) else None  # noqa: E731, B023
                rows.append([
                    {"text": p, "start": s, "heading": above(s)} | ({"children": [{"text": c, "start": o} for c, o in located(p, split_text(p, *child))]} if child else {})
                    for p, s in found
                ])
            yield pa.RecordBatch.from_arrays([b.column("document_id"), pa.array(rows, parents)], names=["document_id", "parents"])

    shape = f"array<struct<text:string,start:bigint,heading:string{',children:array<struct<text:string,start:bigint>>' if child else ''}>>"
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, parents {shape}")


def page_range(pages: Column, start: Column, end: Column) -> Column:
    """first_page that holds the start, last_page that holds the last character, and the least confidence of all pages.

    pages: array of (start, end, page, confidence), ends excluded.
    """
    at = lambda p: F.filter(pages, lambda x: (x["start"] <= p) & (p < x["end"]))
    return F.struct(
        F.try_element_at(at(start), F.lit(1))["page"].alias("first_page"), F.try_element_at(at(end - 1), F.lit(1))["page"].alias("last_page"),
        F.array_min(F.transform(pages, lambda x: x["confidence"])).alias("ocr_confidence"),
    )


def image_chunks(images: DataFrame) -> DataFrame:
    """C17: a child of each image (parent_id, data, alt_text): its description or a sign, and the hash of its first 100 bytes."""
    text = F.coalesce(F.nullif("alt_text", F.lit("")), F.lit(fixed.IMAGE_TEXT))
    return images.withColumns(
        {"text": text, "token_count": tx.token_estimate(text), "modality": F.lit("image"), "content_hash": F.sha2(F.substring("data", 1, 100), 256)}
    )


def page_chunks(pages: DataFrame, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """(document_id, page_number, chunk_index, content, chunk_type) of pages (document_id, page_number, text, tables, is_scanned).

    A page's tables come first, each whole. A page without much text of its own is a placeholder
    if it is scanned and nothing else if not; else its text without the tables is cut in windows.
    Indexes run through the document.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in ("document_id", "page_number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows, contents, types = [], [], []
            for i, (text, tables, scanned) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "tables", "is_scanned")))):
                found, text = [(t, "table") for t in tables or []], text or ""
                if len(text.strip()) < least:
                    found += [(fixed.SCANNED_TEXT, "image")] if scanned else []
                else:
                    for t in tables or []:
                        text = text.replace(t, "")
                    found += [(c, "text") for c in window_chunks(text.strip(), size, overlap, least) if c]
                rows += [i] * len(found)
                contents += [c for c, _ in found]
                types += [t for _, t in found]
            own = b.select(["document_id", "page_number"]).take(pa.array(rows, pa.int64()))
            place = pa.array(range(len(rows)), pa.int64())
            yield pa.RecordBatch.from_arrays([*own.columns, place, pa.array(contents, pa.string()), pa.array(types, pa.string())], names=["document_id", "page_number", "_at", "content", "chunk_type"])

    cut = pages.select("document_id", "page_number", "text", "tables", "is_scanned").mapInArrow(
        run, f"document_id {kinds[0]}, page_number {kinds[1]}, _at long, content string, chunk_type string"
    )
    order = Window.partitionBy("document_id").orderBy("page_number", "_at")
    return cut.withColumn("chunk_index", F.row_number().over(order) - 1).drop("_at")


def page_at(pages: Column, position: Column) -> Column:
    """The page (array of start, end, page) that holds a place, ends included; the first one, and 1 if none."""
    return F.coalesce(F.try_element_at(F.filter(pages, lambda p: (p["start"] <= position) & (position <= p["end"])), F.lit(1))["page"], F.lit(1))


def parents_and_children(
    docs: DataFrame, parent: int = 800, parent_overlap: int = 100, child: int = 200, child_overlap: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of docs (document_id, text), with stable ids `document:parent:child`.

    parents: parent_id, document_id, index_in_document, text, token_count, start, end, section_heading.
    children: child_id, parent_id, document_id, index_in_parent, text, token_count,
    start_char_offset, end_char_offset, modality, content_hash.
    """
    def exploded(children: tuple[int, int] | None) -> DataFrame:
        rows = _nested(docs, parent, parent_overlap, children).select("document_id", F.posexplode("parents").alias("n", "p"))
        return rows.withColumn("parent_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("n").cast("string")))

    parents = exploded(None).select(
        "parent_id", "document_id", F.col("n").alias("index_in_document"), F.col("p.text").alias("text"),
        tx.token_estimate(F.col("p.text")).alias("token_count"), F.col("p.start").alias("start"),
        (F.col("p.start") + F.length("p.text")).alias("end"), F.col("p.heading").alias("section_heading"),
    )
    rows = exploded((child, child_overlap)).select("parent_id", "document_id", F.posexplode("p.children").alias("n", "c"))
    text = F.col("c.text")
    children = rows.select(
        F.concat_ws(":", "parent_id", F.col("n").cast("string")).alias("child_id"), "parent_id", "document_id", F.col("n").alias("index_in_parent"),
        text.alias("text"), tx.token_estimate(text).alias("token_count"), F.col("c.start").alias("start_char_offset"),
        (F.col("c.start") + F.length(text)).alias("end_char_offset"), F.when(tx.is_table(text), "table").otherwise("text").alias("modality"),
        tx.content_hash(text).alias("content_hash"),
    )
    return parents, children


def flat_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """(document_id, chunk_index, content, content_hash) windows of every document."""
    kind = docs.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows = [window_chunks(x.as_py() or "", size, overlap, least) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("document_id"), pa.array(rows, pa.list_(pa.string()))], names=["document_id", "chunks"])

    cut = docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, chunks array<string>")
    rows = cut.select("document_id", F.posexplode("chunks").alias("chunk_index", "content")).where("content <> ''")
    return rows.withColumn("content_hash", tx.content_hash(F.col("content")))


def regroup(chunks: DataFrame, size: int = 5) -> DataFrame:
    """(document, parent_index, text): a document's chunks in order, `size` to a parent."""
    order = Window.partitionBy("document").orderBy("chunk_index")
    numbered = chunks.withColumn("parent_index", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return numbered.groupBy("document", "parent_index").agg(F.array_join(texts, "\n\n").alias("text"))
