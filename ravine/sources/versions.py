"""Tables that change by commits: Parquet files behind numbered manifests, without a table format.

A table is a folder. Data files lie in folders of their own, never changed once written; a
manifest names those that make up one version, by bucket of the key, and what was done to get
there. A commit writes the new files first and the next manifest last, so a job that dies leaves
the old version whole, and readers see one version or the next. Only buckets that a change touches
are written anew. Every commit has a name: a rerun under a name that was committed changes nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only a local session (as in tests) may leave that unset; a temporary folder is taken then.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        fs, path = file_system(spark, named)
        return fs.makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_folder, "own", None):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="spark-ravine-")
    return shared_folder.own


def file_system(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, path: str) -> str:
    """Name, size and time of every data file under path: changes when the table does."""
    fs, at = file_system(spark, path)
    files = fs.listFiles(at, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(sorted(out))).hex


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df into the shared folder and read it back: what several parts of a plan read is computed once, and a lost executor costs none of it."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another commit took the version that this one was built on; run it again."""


@dataclass
class Versioned:
    """A table at a folder, its rows kept by `buckets` buckets of the key columns.

    Rows of one key lie in one bucket; a bucket may have many files, and none is read or written
    in one piece. buckets is fixed by the first commit; with 0 buckets rows are written where they
    lie, without a shuffle or a sort, and a key is looked for in all files.
    """

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    buckets: int = 16

    def _manifests(self) -> list[str]:
        fs, at = file_system(self.spark, f"{self.folder}/manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest that was written to its end, or the one of a version."""
        empty = {"version": 0, "schema": None, "paths": [], "commits": [], "notes": {}, "buckets": self.buckets}
        for name in reversed(self._manifests()):
            if version is not None and int(name) > version:
                continue
            fs, at = file_system(self.spark, f"{self.folder}/manifests/{name}")
            stream = fs.open(at)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except json.JSONDecodeError:  # its writer died
                continue
        return empty

    def committed(self, name: str) -> bool:
        return name in self.manifest()["commits"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"nothing was committed to {self.folder}")
        return self._rows(m, None)

    def of_key(self, *values: Column) -> DataFrame:
        """The rows of the bucket in which a key's rows lie; the other buckets' files are not opened."""
        m = self.manifest()
        bucket = self.spark.range(1).select(self._bucket(m, *values)).first()[0]
        return self._rows(m, {bucket})

    def _rows(self, m: dict, only: set[int] | None) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        paths = [p for b, p in m["paths"] if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, m: dict, *values: Column) -> Column:
        """The bucket of a row, or of a key's values."""
        return F.pmod(F.xxhash64(*(values or self.key)), F.lit(m["buckets"])).cast("int") if m["buckets"] else F.lit(0)

    def _write(self, df: DataFrame, m: dict) -> list[tuple[int, str]]:
        """Write df by bucket; the folders written."""
        home = f"{self.folder}/data/{uuid.uuid4().hex}"
        if not m["buckets"]:
            df.write.parquet(f"{home}/all")
            return [(0, f"{home}/all")]
        dealt = df.withColumn(BUCKET, self._bucket(m))
        dealt.repartition(BUCKET, F.pmod(F.xxhash64(*(F.col(c) for c in df.columns if df.schema[c].dataType.typeName() != "map")), F.lit(4))).write.partitionBy(BUCKET).parquet(home)
        fs, at = file_system(self.spark, home)
        names = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
        return [(int(p.getName().split("=")[1]), p.toString()) for p in names]

    def _commit(self, m: dict, paths: list, schema: StructType, name: str, notes: dict | None) -> None:
        number = int((self._manifests() or ["0"])[-1]) + 1
        if self.manifest()["version"] != m["version"]:
            raise Conflict(f"{self.folder} is at version {self.manifest()['version']}, not {m['version']}")
        new = {"version": number, "schema": json.loads(schema.json()), "paths": paths, "commits": [*m["commits"], name], "notes": {**m["notes"], **({name: notes} if notes else {})}, "buckets": m["buckets"]}
        fs, at = file_system(self.spark, f"{self.folder}/manifests/{number:010d}")
        try:
            out = fs.create(at, False)  # fails where the file is there
        except Exception as e:
            raise Conflict(f"version {number} of {self.folder} was taken") from e
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()

    def append(self, df: DataFrame, name: str, notes: dict | None = None) -> bool:
        """Add rows beside the others, once for each name; whether it was done now."""
        m = self.manifest()
        if name in m["commits"]:
            return False
        self._commit(m, [*m["paths"], *self._write(df, m)], df.schema, name, notes)
        return True

    def _rewrite(self, touched: DataFrame, change, schema: StructType, name: str) -> bool:
        m = self.manifest()
        if name in m["commits"]:
            return False
        hit = {r[0] for r in touched.select(self._bucket(m)).distinct().collect()}  # as many rows as buckets at most
        new = self._write(change(self._rows(m | {"schema": m["schema"] or json.loads(schema.json())}, hit)), m) if hit else []
        kept = [(b, p) for b, p in m["paths"] if b not in hit]
        self._commit(m, [*kept, *new], schema, name, None)
        return True

    def upsert(self, new: DataFrame, name: str) -> bool:
        """Rows of new replace those of the same key; new keys are added. A key may occur once in new; nulls are no key."""
        schema = StructType.fromJson(self.manifest()["schema"] or json.loads(new.schema.json()))
        rows = new.select(*schema.names)
        return self._rewrite(rows, lambda old: old.join(rows.select(*self.key), list(self.key), "left_anti").select(*schema.names).unionByName(rows), schema, name)

    def delete(self, keys: DataFrame, name: str) -> bool:
        """Drop the rows of the given keys."""
        schema = StructType.fromJson(self.manifest()["schema"])
        return self._rewrite(keys, lambda old: old.join(keys.select(*self.key), list(self.key), "left_anti").select(*schema.names), schema, name)

    def change(self, keys: DataFrame, values: dict[str, Column], name: str, where: Column | None = None) -> bool:
        """Set columns of the rows of the given keys, where the condition holds (a status that moves on only from a given one)."""
        schema = StructType.fromJson(self.manifest()["schema"])
        mark = keys.select(*self.key).distinct().withColumn("_hit", F.lit(True))

        def changed(old: DataFrame) -> DataFrame:
            hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
            rows = old.join(mark, list(self.key), "left")
            return rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(schema[c].dataType).alias(c) if c in values else c for c in schema.names))

        return self._rewrite(keys, changed, schema, name)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data folders that none of the newest `keep` versions reads; how many. Not while a commit runs."""
        wanted = {p for name in self._manifests()[-keep:] for _, p in self.manifest(int(name))["paths"]}
        fs, at = file_system(self.spark, f"{self.folder}/data")
        gone = 0
        for home in fs.listStatus(at) if fs.exists(at) else []:
            if not any(p.startswith(home.getPath().toString() + "/") for p in wanted):
                gone += bool(fs.delete(home.getPath(), True))
        return gone
