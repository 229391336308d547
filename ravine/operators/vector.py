"""Vector retrieval by exact scans for batches of queries; vector_index.py has an approximate one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ravine.functions import vectors as vx
from ravine.operators.lexical import top

UNIT = 16_384  #: vectors, and queries, that one task compares at a time
_TILE = 512  #: queries whose products with a unit are held at once
_NULL, _NAN = -9.0, 9.0  # keys beyond all similarities: null comes last, NaN first, as Spark sorts them


def unit(df: DataFrame, column: str = "embedding", dims: int | None = None) -> DataFrame:
    """df with column as an array of doubles of unit length, cut to dims first; null vectors are dropped."""
    v = vx.doubles(F.col(column))
    return df.where(F.col(column).isNotNull()).withColumn(column, vx.normalized(F.slice(v, 1, dims) if dims else v))


def similar(queries: DataFrame, chunks: DataFrame, k: int = 100, dims: int | None = None, by: list[str] | None = None, places: int | None = None) -> DataFrame:
    """V2, V3: the k most similar chunks (child_id, embedding) of each query (query_id, embedding), with similarity and rank.

    Queries are a stated set that every chunk is compared with; `by` names columns that both sides
    have to agree in (a collection, a category). Vectors are normalised once, so a product is a
    similarity; a zero vector has similarity 0. With `places`, similarities are rounded to them before
    they are ranked, so what differs in no place given goes by the id.
    """
    by = by or []
    asked = unit(queries, dims=dims).select("query_id", *by, F.col("embedding").alias("asked"))
    held = unit(chunks, dims=dims).select("child_id", *by, "embedding")
    for c in by:
        asked, held = asked.where(F.col(c).isNotNull()), held.where(F.col(c).isNotNull())
    # units of both sides meet, so that neither pairs nor one whole side lie in a task
    parts, groups = (-(-df.where("embedding is not null").count() // UNIT) or 1 for df in (chunks, queries))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*by, "_group", "_part"]
    ask = asked.withColumn("_group", dealt("query_id", groups)).withColumn("_part", every(parts))
    hold = held.withColumn("_part", dealt("child_id", parts)).withColumn("_group", every(groups))
    out = StructType([queries.schema["query_id"], chunks.schema["child_id"]]).add("similarity", "double")
    near = ask.groupBy(*keys).cogroup(hold.groupBy(*keys)).applyInArrow(_best(k, to_arrow_schema(out), 0.0 if places is None else 10.0**-places), out)
    near = near if places is None else near.withColumn("similarity", F.round("similarity", places))
    return top(near, "similarity", k)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros, and their lengths; -1 for one with a null component."""
    lists = column.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    lengths[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, lengths


def _keys(scores: np.ndarray, asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Scores as keys to sort by, from both sides' lengths: null where these differ or a component is null."""
    keys = np.where(np.isnan(scores), _NAN, scores)
    keys[(asked != held) | (asked < 0)] = _NULL
    return keys


def _best(k: int, schema: pa.Schema, slack: float = 0.0):
    """The k most similar vectors of one unit for each query of another; ties by the smaller id.

    A matrix product finds the candidates, all within rounding of the k-th; these are then multiplied
    in the order of their components, as vx.dot() does, and cut to k. Of equal vectors the k of the
    smallest ids are enough. With slack > 0 all that lie within it under the k-th stay.
    """

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by("child_id")
        q, nq = _matrix(asked["asked"])
        h, nh = _matrix(held["embedding"])
        width = max(q.shape[1], h.shape[1], 1)
        q, h = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, h))
        copy = np.unique(np.ascontiguousarray(np.column_stack([h + 0.0, nh])).view(np.dtype((np.void, 8 * (width + 1)))).ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(copy, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(copy[order]) != 0])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        kept = np.sort(order[place < k])
        h, nh, ids = h[kept], nh[kept], held["child_id"].take(pa.array(kept))
        found = []
        for start in range(0, len(q), _TILE):
            x, nx = q[start : start + _TILE], nq[start : start + _TILE]
            with np.errstate(all="ignore"):
                keys = _keys(x @ h.T, nx[:, None], nh[None])
            least = np.partition(keys, len(h) - k, axis=1)[:, len(h) - k, None] if len(h) > k else _NULL
            row, col = np.nonzero(keys >= least - slack - 1e-9)
            score = np.zeros(len(row))
            with np.errstate(all="ignore"):
                for i in range(width):
                    score += x[row, i] * h[col, i]
            key = _keys(score, nx[row], nh[col])
            order = np.lexsort((col, -key, row))
            row, col, key, score = row[order], col[order], key[order], score[order]
            first = np.flatnonzero(np.r_[True, np.diff(row) != 0])
            top_ = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < (k if not slack else len(h))
            found.append((row[top_] + start, col[top_], pa.array(score[top_], pa.float64(), mask=key[top_] == _NULL)))
        rows, cols = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(rows)), ids.take(pa.array(cols)), pa.chunked_array([f[2] for f in found])], schema=schema)

    return best


def nearest(chunks: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k most similar chunks of one query vector: a scan and a top-k, without a shuffle of the vectors."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.where("embedding is not null").select("child_id", vx.cosine(vx.doubles(F.col("embedding")), asked).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "child_id").limit(k)
