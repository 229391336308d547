"""Near-duplicate vectors of one label by spherical k-means cells and blocked cosine products.

Spherical k-means (Dhillon and Modha 2001), fitted on a bounded sample, gives every vector a
home cell: the centroid with the largest inner product. Linked vectors can have different
homes. If y lies in cell d and x in cell c, then y.(d - c) >= 0, so x.(d - c) >= -|x - y| |d - c|,
and |x - y| is at most sqrt(2 - 2 t) for unit vectors with cosine t: x visits every cell for
which this holds as a guest, so no link is lost. In a cell, all visitors are multiplied with
all residents, in blocks of at most about BLOCK rows of either kind.

Equal vectors of a label are one class with a count, so copies are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravine.llm.common import local_roots, slabs, stored
from ravine.llm.components import components

#: Residents, and visitors, of a block.
BLOCK = 2048


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit row vectors; a cell that loses all its vectors keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keyed(vectors: DataFrame) -> DataFrame:
    """vectors with _key, the same for equal usable vectors of a label, null for those that link with nothing."""
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return vectors.withColumn("_key", F.when(usable, _key()))


def _key() -> Column:
    halves = (F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label"))
    return F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves))


def _sampled(classes: DataFrame, rows: int, dims: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """About `rows` unit vectors of each dimension, those with the smallest keys."""
    out = {}
    for dim, n in dims:
        limit = min(0xFFFFFFFF, int(rows / n * 0x100000000))
        some = classes.where((F.col("dim") == dim) & (F.substring("key", 1, 8) <= f"{limit:08X}"))
        got = np.array([r["embedding"] for r in some.select("embedding").collect()], np.float64).reshape(-1, dim)
        norms = np.linalg.norm(got, axis=1, keepdims=True)
        out[dim] = got / norms if len(got) else np.eye(1, dim)
    return out


def embedding_components(
    vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 4096, most_cells: int = 4096, sample_rows: int = 16384
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows with equal labels are linked if the cosine of their embeddings, in double precision, is
    at least threshold. A null label, a null, empty or zero vector, a null or non-finite
    component link with nothing; vectors of different lengths are not compared. Repeated rows
    are vectors of their own. component_id is the smallest vec_id reachable (nulls aside), kept
    says whether it is the row's own. Other columns are not read; an empty table gives an
    empty table.

    sample_rows bounds the vectors that k-means is fitted on; there is a cell for each cell_rows
    different vectors, most_cells at most.
    """
    spark = vectors.sparkSession
    keyed = _keyed(vectors.select("vec_id", "embedding", "label"))
    classes = stored(
        keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(
            F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least_id")
        ).withColumn("dim", F.size("embedding")),
        "classes",
    )
    dims = [(r["dim"], r["m"]) for r in classes.groupBy("dim").agg(F.count("*").alias("m")).collect()]
    samples = _sampled(classes, sample_rows, dims)
    centroids = {d: fit_cells(samples[d], max(1, min(most_cells, math.ceil(m / cell_rows)))) for d, m in dims}
    shipped = spark.sparkContext.broadcast(centroids)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            for d in np.unique(dim):
                part = b.filter(pa.array(dim == d))
                cells = shipped.value[int(d)]
                x = _matrix(part.column("embedding"))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                inner = x @ cells.T
                home = inner.argmax(axis=1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * (cells @ cells.T)))[home]
                row, cell = np.nonzero(inner >= inner[np.arange(len(x)), home][:, None] - reach * gap - 1e-12)
                taken = part.select(["key", "label", "embedding", "n", "dim"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell), pa.array(home[row] == cell)],
                    names=["key", "label", "embedding", "n", "dim", "cell", "resident"],
                )

    kind = classes.schema["label"].dataType.simpleString()
    item = classes.schema["embedding"].dataType.simpleString()
    placed = classes.mapInArrow(visits, f"key string, label {kind}, embedding {item}, n long, dim int, cell long, resident boolean")
    placed = stored(placed, "visits")
    at = ["label", "dim", "cell"]
    sizes = placed.groupBy(*at).agg(
        F.ceil(F.count_if("resident") / BLOCK).cast("long").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("long").alias("columns")
    )
    sized = placed.join(sizes, at)
    until = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    row = ["key", "embedding", "n"]
    residents = sized.where("resident").select(*at, *row, own("rows").alias("r"), F.explode(until("columns")).alias("c"), F.lit(True).alias("is_row"))
    visitors = sized.where("rows > 0").select(*at, *row, F.explode(until("rows")).alias("r"), own("columns").alias("c"), F.lit(False).alias("is_row"))
    units = residents.unionByName(visitors).select(F.xxhash64(*at, "r", "c").alias("unit"), "is_row", *row)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "unit"):
            unit = slab.column("unit").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            for s, e in zip(cuts, [*cuts[1:], len(unit)]):
                yield _linked(slab.slice(s, e - s), threshold)

    dealt = units.repartition("unit").sortWithinPartitions("unit")
    found = stored(dealt.mapInArrow(products, "key string, links long, root string"), "products")
    linked = components(found.where("root is not null"), "key", "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    rooted = classes.select("key", "n", "least_id").join(links, "key", "left").join(linked, F.col("key") == F.col("node"), "left")
    rooted = rooted.select("key", "n", "least_id", "links", F.coalesce("root", "key").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    final = rooted.join(tops, "root").select(
        F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = keyed.select("vec_id", "_key").join(stored(final, "final"), "_key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _linked(unit: pa.Table, threshold: float) -> pa.RecordBatch:
    """Of a block: each visitor's number of linked vectors, and a root for whatever is linked."""
    is_row = unit.column("is_row").to_numpy(zero_copy_only=False)
    vectors, key = _matrix(unit.column("embedding")), np.array(unit.column("key").to_pylist())
    norms = np.linalg.norm(vectors, axis=1)
    rows, columns = np.flatnonzero(is_row), np.flatnonzero(~is_row)
    cosine = (vectors[columns] @ vectors[rows].T) / (norms[columns][:, None] * norms[rows][None])
    near = (cosine >= threshold) & (key[columns][:, None] != key[rows][None])
    links = np.zeros(len(key), np.int64)
    links[columns] = near.astype(np.float64) @ unit.column("n").to_numpy()[rows]
    a, b = np.nonzero(near)
    root = local_roots(len(key), columns[a], rows[b])
    said = np.flatnonzero((links > 0) | (root != np.arange(len(key))))
    roots = np.where(root[said] != said, key[root[said]], None)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[said], pa.string()), pa.array(links[said]), pa.array(roots, pa.string())], names=["key", "links", "root"]
    )


def drop_near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vectors without those whose component has a smaller vec_id; all columns are kept."""
    gone = embedding_components(vectors, threshold).where("not kept").select(F.col("vec_id").alias("_gone_id")).distinct()
    return vectors.join(gone, vectors.vec_id.eqNullSafe(gone._gone_id), "left_anti")
