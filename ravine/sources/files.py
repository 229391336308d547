"""Files to pages: one row (document_id, path, hash, page, text, tables, scanned, error) for each page.

What cannot be read keeps a row with its error and no text. DOCX and XLSX files are archives of
XML, read with the standard library; PDF needs a library that may be absent, and says so.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravine.functions import text as tx

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PAGES = "page int, text string, tables array<string>, scanned boolean, error string"


def markdown(rows: list[list[str]]) -> str:
    """Ragged rows as a Markdown table, the first one as its head."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def _docx(data: bytes) -> Iterator[tuple[int, str, list[str], bool]]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_WORD}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    parts, tables = [], []
    for e in body:
        if e.tag == f"{_WORD}tbl":
            tables.append(markdown([[words(c) for c in r.findall(f"{_WORD}tc")] for r in e.findall(f"{_WORD}tr")]))
            parts.append(tables[-1])
        elif e.tag == f"{_WORD}p" and words(e).strip():
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            heading = style is not None and style.get(f"{_WORD}val", "").startswith("Heading")
            parts.append(f"\n## {words(e)}\n" if heading else words(e))
    yield 1, "\n".join(parts), tables, False


def _xlsx(data: bytes) -> Iterator[tuple[int, str, list[str], bool]]:
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
    for n, name in enumerate(names, 1):
        rows = []
        for r in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{n}.xml")).iter(f"{_SHEET}row"):
            cells = []
            for c in r.findall(f"{_SHEET}c"):
                v = c.find(f"{_SHEET}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
            if any(x and x.strip() for x in cells):
                rows.append([x or "" for x in cells])
        if rows:
            yield n, f"## Sheet: {name}\n{markdown(rows)}", [markdown(rows)], False


def _csv(data: bytes) -> Iterator[tuple[int, str, list[str], bool]]:
    table = markdown(list(csv.reader(io.StringIO(data.decode("utf-8", "replace")))))
    yield 1, table, [table] if table else [], False


def _pdf(data: bytes) -> Iterator[tuple[int, str, list[str], bool]]:
    from pypdf import PdfReader

    for n, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
        text = page.extract_text() or ""
        area = float(page.mediabox.width) * float(page.mediabox.height)
        yield n, text, [], scanned(len(text), area)


def scanned(chars: int, area: float) -> bool:
    """Fewer than one character for each 1000 square points."""
    return chars / (area + 1) < 0.001


_READERS = {
    "txt": lambda data: iter([(1, data.decode("utf-8", "replace"), [], False)]),
    "csv": _csv,
    "docx": _docx,
    "xlsx": _xlsx,
    "pdf": _pdf,
    "image": lambda data: iter([(1, "", [], True)]),
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The pages of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return pages_of(files.select("path", "content"))


def pages_of(files: DataFrame) -> DataFrame:
    """Pages of files (path, content)."""
    typed = files.select(F.sha2("content", 256).alias("hash"), "path", tx.file_kind(F.col("path")).alias("kind"), tx.mime_type(F.col("path")).alias("mime_type"), "content")
    names = ["hash", "path", "kind", "mime_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page", pa.int32()), ("text", pa.string()), ("tables", pa.list_(pa.string())), ("scanned", pa.bool_()), ("error", pa.string())])
        for b in batches:
            at, rows = [], []
            for i, (kind, data) in enumerate(zip(b.column("kind").to_pylist(), b.column("content"))):
                try:
                    if kind not in _READERS:
                        raise ValueError(f"unsupported type: {kind}")
                    found = [(*p, None) for p in _READERS[kind](data.as_py() or b"")]
                except Exception as e:  # a bad file is a row, not a failed job
                    found = [(None, None, None, None, f"{type(e).__name__}: {e}")]
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows)) or [()] * 5
            own = b.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, f.type) for c, f in zip(columns, kinds))], names=[*names, *kinds.names])

    return typed.mapInArrow(run, "hash string, path string, kind string, mime_type string, " + PAGES)


def full_text(pages: DataFrame, by: str = "hash") -> DataFrame:
    """A document's pages that have text, between empty lines, and where each begins and ends."""
    own = pages.where("coalesce(text, '') <> ''").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    starts = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,page:int>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p["text"]) + 2).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(p["text"])).alias("end"), p["page"].alias("page")))).alias("out")),
        lambda s: s["out"],
    )
    return own.select(by, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), starts.alias("pages"))


def strip_html(html: Column) -> Column:
    """Text of a web page: scripts, styles and tags removed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r\\f\\x0B]+", " "))


