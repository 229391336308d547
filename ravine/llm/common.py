"""Helpers shared by the corpus operators: tables in the shared folder, tokens, column names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark drops a job's shuffle files when the job ends, not when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it, with its file system.

    Only a local session (as in tests) may leave spark.checkpoint.dir unset; a temporary folder
    is taken then.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-ravine-")
    return shared_dir.own


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there.

    A lost executor costs nothing of what is stored.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() once no later plan reads them."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, *without: str) -> Column:
    """All columns of df in one struct, so that names beside it cannot clash with them."""
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c not in without))


def unpacked(df: DataFrame, row: str, *without: str) -> list[Column]:
    """The columns of a packed() struct, by their names."""
    return [F.col(f"{row}.`{c}`").alias(c) for c in df.schema[row].dataType.names[1:] if c not in without]


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def lowered_words(text: str | None) -> list[bytes]:
    """UTF-8 words [^\\x20\\x09-\\x0D]+ with A-Z lowered; bytes.lower and bytes.split do exactly this."""
    return text.encode("utf-8").lower().split() if text else []


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that what a task makes of one stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def slabs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by key so that no key's rows are split between two slabs.

    Memory is that of a batch and of one key's rows, so callers bound the rows of a key.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut or (held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def each_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, one key at a time, of batches that are sorted by key."""
    for slab in slabs(batches, key):
        k = slab.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        for s, e in zip(cuts, [*cuts[1:], len(k)]):
            yield slab.slice(s, e - s)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, bit by bit, since DuckDB has no such function."""
    step = "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {step})"
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {codes}), {byte}), 4294967295)"
