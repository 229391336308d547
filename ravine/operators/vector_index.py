"""A stored vector index: cells, product-quantised residuals, exact reranking.

Unit vectors are put into the nearest of about sqrt(n) cells; what remains of each after its
cell's centre is stored as one byte for every `part` dimensions (Jegou, Douze and Schmid 2011).
A query visits the cells nearest to it, ranks their vectors by their codes, and compares exactly
only the best few of those. Cells and codebooks are fitted on a bounded sample, every vector is
indexed, and how many cells and candidates a query needs is measured at the build against the
exact neighbours of a stated set of the indexed vectors.

The index is a Versioned table with the cell as key, beside a small table of the model. Codes,
not vectors, are shuffled by cell; a cell of very many vectors is searched in units of at most
about UNIT, and a batch of queries in groups of QUERIES, so no task holds more than both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ravine.functions import vectors as vx
from ravine.operators.lexical import top
from ravine.operators.vector import similar, unit
from ravine.sources.versions import Versioned, stored

SAMPLE = 16_384  #: vectors that the cells and the codebooks are fitted on
MOST_CELLS = 4_096
UNIT = 8_192  #: vectors of a cell that one task ranks for a group of queries
QUERIES = 1_024
ASKED = 256  #: indexed vectors whose exact neighbours set the probes
_CODE = 256  #: centres of a codebook, so that a code is a byte


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centres of the rows of x, a bounded sample; fewer rows than k are their own centres."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


@dataclass
class Model:
    """Centres of the cells, codebooks of the residuals' parts, and how far a query looks."""

    centres: np.ndarray
    books: np.ndarray  # parts x codes x dimensions of a part
    probes: int
    rerank: int

    @staticmethod
    def fitted(x: np.ndarray, cells: int, part: int) -> Model:
        centres = k_means(x, cells)
        rest = x - centres[_nearest(x, centres)]
        parts = [k_means(rest[:, i : i + part], _CODE, seed=i) for i in range(0, x.shape[1], part)]
        width = max(p.shape[1] for p in parts)
        books = np.stack([np.pad(p, ((0, _CODE - len(p)), (0, width - p.shape[1])), mode="edge" if len(p) < _CODE else "constant") if p.shape != (_CODE, width) else p for p in parts])
        return Model(centres, books, len(centres), 500)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows of x cut into parts, padded with zeros: rows x parts x width."""
        width = self.books.shape[2]
        padded = np.zeros((len(x), len(self.books) * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), len(self.books), width)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each row."""
        cell = _nearest(x, self.centres)
        rest = self.parts(x - self.centres[cell])
        return cell, np.stack([_nearest(rest[:, i], self.books[i]) for i in range(len(self.books))], axis=1).astype(np.uint8)

    def scores(self, asked: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Similarities of each query to each code of a cell, as the codes have them."""
        looked = np.einsum("qpw,pcw->qpc", self.parts(asked), self.books)
        out = np.repeat((asked @ self.centres[cell])[:, None], len(codes), axis=1)
        for i in range(codes.shape[1]):
            out += looked[:, i, codes[:, i]]
        return out


def _units(rows: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """A column of vectors as rows of unit length; zeros stay zeros."""
    values = rows.column(column)
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) != len(values) * dims:
        raise ValueError(f"the index holds vectors of {dims} dimensions, others were given")
    x = x.reshape(-1, dims)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _encoder(model: Model):
    def encode(batches):
        for batch in batches:
            cell, codes = model.encoded(_units(batch, "embedding", model.centres.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("child_id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding")], ["cell", "child_id", "code", "embedding"])

    return encode


def _visitor(model: Model, probes: int, parts: np.ndarray, schema: pa.Schema):
    """The units that each query visits: all of its nearest cells'."""

    def visit(batches):
        for batch in batches:
            x = _units(batch, "embedding", model.centres.shape[1])
            far = (model.centres * model.centres).sum(1) - 2 * x @ model.centres.T
            cells = np.argsort(far, axis=1, kind="stable")[:, :probes]
            counts = parts[cells]
            row = np.repeat(np.arange(len(x)), counts.sum(1))
            flat, cell = counts.ravel(), np.repeat(cells.ravel(), counts.ravel())
            part = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([picked.column(f.name) if f.name in batch.schema.names else pa.array((cell if f.name == "cell" else part).astype(np.int32)) for f in schema], schema=schema)

    return visit


def _ranker(model: Model, rerank: int, schema: pa.Schema):
    """The best candidates of one unit for each of a group's queries."""

    def rank(asked, held):
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        x = _units(asked.combine_chunks().to_batches()[0], "embedding", model.centres.shape[1])
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        scores = model.scores(x, held["cell"][0].as_py(), codes)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :rerank]
        row = np.repeat(np.arange(len(x)), best.shape[1])
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(row)), held["child_id"].take(pa.array(best.ravel())), held["cell"].take(pa.array(best.ravel())), pa.array(scores[row, best.ravel()])], schema=schema)

    return rank


@dataclass
class VectorIndex:
    """The index at a folder; spark reads and writes it."""

    spark: SparkSession
    folder: str
    buckets: int = 16

    @property
    def table(self) -> Versioned:
        return Versioned(self.spark, f"{self.folder}/vectors", ("cell",), self.buckets)

    @property
    def _models(self) -> Versioned:
        return Versioned(self.spark, f"{self.folder}/model", ("step",), 1)

    @cached_property
    def model(self) -> Model:
        """The newest of its small table: at most MOST_CELLS centres and the codebooks."""
        row = self._models.read().orderBy(F.desc("step")).first()
        return Model(np.frombuffer(row.centres).reshape(row.cells, -1), np.frombuffer(row.books).reshape(row.parts, _CODE, -1), row.probes, row.rerank)

    def add(self, vectors: DataFrame, name: str, part: int = 4, recall: float = 0.98, k: int = 10) -> bool:
        """Index vectors (child_id, embedding) under a commit's name, once; whether it was done now.

        The first commit fits the model, with about sqrt(n) cells, on some SAMPLE vectors by the
        hashes of their ids, and then measures how many cells and candidates hold the share
        `recall` of the k exact neighbours of some ASKED indexed vectors. Null vectors are passed
        over; zero vectors are indexed. All others have one number of dimensions.
        """
        if self.table.committed(name):
            return False
        held = vectors.where("embedding is not null").select("child_id", "embedding")
        first = self.table.manifest()["version"] == 0
        if first:
            self._fit(held, part)
        out = StructType().add("cell", "integer").add(held.schema["child_id"]).add("code", "binary").add(held.schema["embedding"])
        self.table.append(held.mapInArrow(_encoder(self.model), out), name)
        if first:
            self._calibrate(recall, k)
        return True

    def _sampled(self, df: DataFrame, rows: int, wanted: int) -> DataFrame:
        """About `wanted` of `rows` rows, by the hashes of their ids."""
        return df.where(F.pmod(F.xxhash64("child_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(rows, 1)) * (1 << 30))))

    def _fit(self, held: DataFrame, part: int) -> None:
        rows = held.count()
        sample = [r.embedding for r in unit(self._sampled(held, rows, SAMPLE)).select("embedding").limit(2 * SAMPLE).collect()]
        x = np.array(sample) if sample else np.zeros((1, 1))
        self._save(Model.fitted(x, max(1, min(MOST_CELLS, int(rows**0.5))), part))

    def _save(self, model: Model) -> None:
        step = self._models.manifest()["version"]
        row = (step, len(model.centres), len(model.books), model.probes, model.rerank, model.centres.astype(float).tobytes(), model.books.astype(float).tobytes())
        self._models.append(self.spark.createDataFrame([row], "step int, cells int, parts int, probes int, rerank int, centres binary, books binary"), f"step {step}")
        self.__dict__.pop("model", None)

    def _calibrate(self, recall: float, k: int) -> None:
        held = self.table.read()
        rows = held.count()
        asked = stored(self._sampled(held, rows, ASKED).select(F.col("child_id").alias("query_id"), "embedding"), "asked")
        exact = stored(similar(asked, held, k).select("query_id", "child_id").join(held.select("child_id", "cell"), "child_id").join(asked, "query_id"), "exact")
        near = exact.select("query_id", "child_id", "cell", "embedding").toPandas()  # ASKED times k rows
        if not len(near):
            return
        x = np.stack(near["embedding"]).astype(float)
        far = (self.model.centres**2).sum(1) - 2 * (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ self.model.centres.T
        own = far[np.arange(len(x)), near["cell"]]
        probes = int(np.quantile((far < own[:, None]).sum(1) + 1, recall, method="higher"))
        ranked = top(self.candidates(asked, probes, 50 * k), "approximate", 50 * k)
        places = exact.select("query_id", "child_id").join(ranked, ["query_id", "child_id"], "left").select(F.coalesce("rank", F.lit(50 * k)).alias("rank")).toPandas()["rank"]
        self._save(Model(self.model.centres, self.model.books, probes, int(np.quantile(places, recall, method="higher"))))

    def candidates(self, queries: DataFrame, probes: int, rerank: int) -> DataFrame:
        """(query_id, child_id, cell, approximate): of each unit that a query (query_id, embedding) visits, its best vectors by their codes.

        The model's figures are measured over these candidates, so what they miss is in them.
        """
        held = self.table.read().select("cell", "child_id", "code")
        counts = held.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each cell, MOST_CELLS at most
        parts = np.zeros(len(self.model.centres), int)
        for r in counts:
            parts[r.cell] = -(-r.n // UNIT)
        groups = -(-queries.count() // QUERIES) or 1
        asked = queries.where("embedding is not null").select("query_id", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("_group"), "embedding")
        visits = StructType([*asked.schema.fields]).add("cell", "integer").add("part", "integer")
        visiting = asked.mapInArrow(_visitor(self.model, probes, parts, to_arrow_schema(visits)), visits)
        size = F.element_at(F.array(*(F.lit(int(p)) for p in parts)) if len(parts) <= 64 else F.from_json(F.lit(str(parts.tolist())), "array<int>"), F.col("cell") + 1)
        dealt = held.withColumn("part", F.pmod(F.xxhash64("child_id"), size).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        out = StructType([queries.schema["query_id"], held.schema["child_id"]]).add("cell", "integer").add("approximate", "double")
        keys = ["_group", "cell", "part"]
        each = min(rerank, 10 + 4 * rerank // probes)  # a query's best lie in many of its cells, so a cell gives four times its share at most
        return visiting.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_ranker(self.model, each, to_arrow_schema(out)), out)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """V8: (query_id, child_id, similarity, rank) of the k most similar vectors of each query (query_id, embedding), as similar() ranks them.

        Approximate: exact among the best `rerank` candidates of the nearest `probes` cells.
        """
        model = self.model
        wanted = max(k, rerank or model.rerank)
        best = top(self.candidates(queries, probes or model.probes, wanted), "approximate", wanted).select("query_id", "child_id", "cell")
        held = self.table.read().select("child_id", "cell", "embedding")
        asked = unit(queries).select("query_id", F.col("embedding").alias("asked"))
        met = unit(held.join(best, ["cell", "child_id"])).join(asked, "query_id")
        return top(met.select("query_id", "child_id", vx.dot(F.col("asked"), F.col("embedding")).alias("similarity")), "similarity", k)
