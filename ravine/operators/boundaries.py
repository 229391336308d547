"""Where models are called: embedding texts and scoring candidates, in batches within tasks.

A model is a function on a list; it runs inside the workers on Arrow batches, so texts never pass
through the driver. A batch whose call fails gives rows that say so, and the others go on. The
defaults here need no model: a feature-hashing embedder and a word-overlap scorer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructType

from ravine.operators.lexical import top

Embedder = Callable[[list[str]], list[list[float] | None]]
Scorer = Callable[[list[tuple[str, str]]], list[float | None]]

#: Texts of a call to an embedder.
EMBED_BATCH = 20
#: Candidates of a query that a scorer sees, and the score of one that it leaves out.
CANDIDATES, LEFT_OUT = 100, 0.5
#: Terms, and characters of one, whose places a worker of the hashing embedder remembers.
REMEMBERED, SHORT = 1 << 17, 32
_TERM = re.compile(r"[^\W_]+")


def hashing_embedder(dims: int = 64) -> Embedder:
    """A deterministic embedder: every lower-case run of letters and digits adds 1 or -1 to one dimension.

    The dimension is the first eight hexadecimal digits of the term's MD5 modulo dims, the sign that
    of the ninth digit's parity (even: plus). Vectors have unit length; a text without terms is zero.
    """

    places: dict[str, int] = {}  # twice the dimension, and 1 more for minus

    def place(term: str) -> int:
        digest = hashlib.md5(term.encode()).digest()
        found = 2 * (int.from_bytes(digest[:4], "big") % dims) + (digest[4] >> 4) % 2
        if len(places) >= REMEMBERED:
            places.clear()
        if len(term) <= SHORT:
            places[term] = found
        return found

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            found = [p if (p := places.get(term)) is not None else place(term) for term in _TERM.findall(text.lower())]
            both = np.bincount(np.array(found, np.int64), minlength=2 * dims)
            row += both[::2] - both[1::2]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0).tolist()

    return embed


def _called(model, items: list, size: int) -> Iterator[tuple[object, str | None]]:
    """The model's answer to each item, or why there is none; one call for `size` items."""
    for k in range(0, len(items), size):
        part = items[k : k + size]
        try:
            answers = list(model(part))
        except Exception as e:  # whatever a model raises becomes rows
            yield from ((None, f"{type(e).__name__}: {e}") for _ in part)
            continue
        yield from ((a, None) for a in [*answers, *[None] * (len(part) - len(answers))][: len(part)])


def embedded(texts: DataFrame, embedder: Embedder, key: str = "child_id", batch: int = EMBED_BATCH, zero: int = 0) -> DataFrame:
    """V9: (key, embedding, error) for every row of texts (key, text); batch texts are embedded by one call.

    A null text, an answer that is missing and a failed call give a null embedding, and error says
    why; with zero > 0 they give a zero vector of that many dimensions instead. Vectors are stored
    as floats. Rows keep their number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([texts.schema[key]]).add("embedding", ArrayType(FloatType())).add("error", "string")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("text").to_pylist()
            asked = [w for w in words if w is not None]
            answers = _called(embedder, asked, batch)
            rows = [(None, "no text") if w is None else next(answers) for w in words]
            vectors = [v if v is not None else [0.0] * zero if zero else None for v, _ in rows]
            said = [e or ("no answer" if v is None else None) for v, e in rows]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(vectors, schema.field(1).type), pa.array(said, pa.string())], schema=schema)

    return texts.select(key, "text").mapInArrow(run, out)


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of the question's different words that the content holds."""
    words = lambda t: {w for w in re.split(r"[ \t\n\r\f\v]+", t.lower()) if w}
    return [len(words(q) & words(c)) / max(len(words(q)), 1) for q, c in pairs]


def rescored(rows: DataFrame, scorer: Scorer, order: str = "rrf_score", most: int = CANDIDATES, batch: int = 32, left_out: float = LEFT_OUT) -> DataFrame:
    """the `most` best rows of each query by `order` with `rerank_score` and `error` of a scorer of (question, content).

    rows has query_id, child_id, question and content. A candidate that the scorer leaves out has
    the score left_out; where a call fails the score is null and error says why, so that what
    follows can fall back on `order`. Null questions and contents read as empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    best = top(rows, order, most).drop("rank")
    out = StructType([*best.schema.fields]).add("rerank_score", "double").add("error", "string")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(q or "", c or "") for q, c in zip(b.column("question").to_pylist(), b.column("content").to_pylist())]
            told = list(_called(scorer, pairs, batch))
            scores = [None if e else left_out if s is None else float(s) for s, e in told]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([e for _, e in told], pa.string())], schema=schema)

    return best.mapInArrow(run, out)
