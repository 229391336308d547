"""Scanned pages: tiles of large images, readings by better modes, and texts of tiles merged into pages.

Reading a tile is a model's work outside of this; its answers come in as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Modes of reading from the weakest to the best.
MODES = ["tiny", "small", "base", "large", "gundam"]

#: What str.strip() takes off, at either end.
_EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def tiled(width: Column, height: Column, least: int = 1500) -> Column:
    """Whether an image is cut into tiles: its longer side has `least` pixels or more. Null without a size."""
    return F.when(width.isNotNull() & height.isNotNull(), F.greatest(width, height) >= least)


def tiles(images: DataFrame, size: int = 1024, overlap: int = 128, most: int = 16) -> DataFrame:
    """(image's columns, tile, x1, y1, x2, y2) of images (width, height), row by row from the top.

    Tiles begin size - overlap apart; if that gives more than `most`, the distance grows by the root of
    the excess, so tiles of very large images no longer meet. Tiles at the right and lower edge are moved back
    to full size. Equal tiles count once, and `most` are kept: the limit is the feature. Images
    without a positive size give no row.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the tile")
    w, h = F.col("width"), F.col("height")
    step = F.lit(size - overlap)
    n = F.ceil(w / step) * F.ceil(h / step)
    wide = F.when(n > most, F.floor(step * F.sqrt(n / most))).otherwise(step).cast("int")

    def starts(span: Column) -> Column:
        begun = F.transform(F.sequence(F.lit(0), F.ceil(span / F.col("_step")).cast("int") - 1), lambda i: i * F.col("_step"))
        return F.transform(begun, lambda a: F.when(a + size >= span, F.greatest(span - size, F.lit(0))).otherwise(a).cast("int"))

    grid = images.where((w > 0) & (h > 0)).withColumn("_step", wide)
    cells = F.flatten(F.transform(starts(h), lambda y: F.transform(starts(w), lambda x: F.struct(x.alias("x"), y.alias("y")))))
    at = grid.withColumn("_cells", F.slice(F.array_distinct(cells), 1, most)).select(*images.columns, F.posexplode("_cells").alias("tile", "_at"))
    x, y = F.col("_at.x"), F.col("_at.y")
    return at.select(
        *images.columns, "tile", x.alias("x1"), y.alias("y1"),
        F.least(x + size, w).cast("int").alias("x2"), F.least(y + size, h).cast("int").alias("y2"),
    )


def escalated(readings: DataFrame, key: str, first: str = "base", threshold: float = 0.6, retries: int = 2) -> DataFrame:
    """(key, mode, confidence, text, error, retry_count): the reading of each page that counts.

    readings (key, mode, confidence, text, error) holds what each mode would answer; a null or missing one failed. Modes
    are tried from `first` upward, at most `retries` times more, until one has no error and a
    confidence of `threshold` or more. If none has, the last one tried stands. A mode read twice counts by its best reading.
    """
    tried = MODES[MODES.index(first) :][: retries + 1]
    place = F.array_position(F.array(*map(F.lit, tried)), F.col("mode")) - 1
    good = F.col("error").isNull() & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold)
    # the first good one, else the last; ties by confidence and text
    rank = F.struct(good.cast("int"), F.when(good, -F.col("_place")).otherwise(F.col("_place")), F.coalesce(F.col("confidence"), F.lit(0.0)), F.coalesce(F.col("text"), F.lit("")))
    row = F.struct("mode", "confidence", "text", "error", F.col("_place").cast("int").alias("retry_count"))
    read = readings.withColumn("_place", place).where("_place >= 0")
    return read.groupBy(key).agg(F.max_by(row, rank).alias("_r")).select(key, "_r.*")


def _lines(texts: list[str]) -> Iterator[tuple[int, str]]:
    return ((i, line) for i, t in enumerate(texts) for line in map(str.strip, (t or "").strip().split("\n")) if line)


class _Likeness:
    """Similarity of one line to others, computed only where its upper bounds reach `least`."""

    def __init__(self, line: str, least: float):
        # the measure is not symmetric: the new line is the first sequence
        self.match, self.least = SequenceMatcher(None, line, ""), least

    def to(self, other: str, above: float = 0.0) -> float:
        """The similarity if it is at least `least` and more than `above`, else 0."""
        m, bound = self.match, max(self.least, above)
        if 2 * min(len(m.a), len(other)) < bound * (len(m.a) + len(other)):
            return 0.0
        m.set_seq2(other)
        if m.quick_ratio() < bound:
            return 0.0
        found = m.ratio()
        return found if found >= self.least and found > above else 0.0


def _without_repeats(texts: list[str], least: float, back: int) -> str:
    out: list[str] = []
    for _, line in _lines(texts):
        like = _Likeness(line, least)
        if not any(like.to(other) for other in out[-back:]):
            out.append(line)
    return "\n".join(out)


def _voted(texts: list[str], trust: list[float], least: float) -> str:
    lines: dict[str, tuple[str, float]] = {}
    for i, line in _lines(texts):
        name, best, found = line.lower(), None, 0.0
        if name in lines:  # equal lines have similarity 1, which no other exceeds
            best = name
        else:
            like = _Likeness(name, least)
            for other in lines:
                if close := like.to(other, found):
                    best, found = other, close
        if best is None:
            lines[name] = line, trust[i]
        elif trust[i] > lines[best][1]:
            del lines[best]
            lines[name] = line, trust[i]
    return "\n".join(line for line, _ in lines.values())


def merged(readings: DataFrame, key: str, how: str = "fuzzy", least: float = 0.85, back: int = 10) -> DataFrame:
    """(key, text, confidence, tiles): each page's text from readings (key, tile, text, confidence) of its tiles.

    concat: stripped texts, an empty line between. fuzzy: lines in order, without those that are at
    least `least` like one of the last `back` kept. vote: each line replaces the most similar one so
    far if its tile has more confidence, and then comes last. The page's confidence is the mean of
    those above zero, 0 without any. A page of a single tile keeps its text as it is. Null texts
    are empty, null confidences 0; readings repeated whole count once. A page has a bounded
    number of tiles (tiles()), which are gathered by Spark; tasks merge batches of pages.
    """
    if how not in ("concat", "fuzzy", "vote"):
        raise ValueError(f"unknown merge {how}")
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    rows = F.sort_array(F.collect_set(F.struct("tile", F.coalesce("text", F.lit("")).alias("text"), sure.alias("confidence"))))
    pages = readings.groupBy(key).agg(rows.alias("_rows"))
    positive = F.filter("_rows.confidence", lambda c: c > 0)
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda s, c: s + c) / F.size(positive)).otherwise(0.0)
    pages = pages.select(key, F.col("_rows.text").alias("_texts"), F.col("_rows.confidence").alias("_trust"), mean.alias("confidence"), F.size("_rows").alias("tiles"))
    if how == "concat":
        kept = F.filter(F.transform("_texts", lambda t: F.regexp_replace(t, _EDGES, "")), lambda t: t != "")
        return pages.select(key, F.array_join(kept, "\n\n").alias("text"), "confidence", "tiles")
    schema = StructType([pages.schema[key]]).add("text", "string").add("confidence", "double").add("tiles", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = zip(b.column("_texts").to_pylist(), b.column("_trust").to_pylist())
            one = (lambda t, c: _without_repeats(t, least, back)) if how == "fuzzy" else (lambda t, c: _voted(t, c, least))
            texts = [t[0] if len(t) == 1 else one(t, c) for t, c in parts]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string()), b.column("confidence"), b.column("tiles")], schema=arrow)

    return pages.mapInArrow(run, schema)
