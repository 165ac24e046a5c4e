"""Tables of hash buckets that are written in place: atomic versions, and only touched buckets rewritten.

A version is one small JSON file, ``versions/v000000000007``, that names the folder of each bucket and the batches
that are in it. A write reads and rewrites the buckets of the new rows' keys, in a new folder, and then creates
the next version's file; what other buckets hold stays where it is. Readers see whole versions only; a writer
that finds its version's file already there has lost a race and fails. A batch that is in the table already
changes nothing, so a stream may repeat one. ``vacuum`` deletes the folders that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer made the version that this one was about to make."""


def newest(order: str, *key: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for write(): of each key the row with the largest order; a new row wins a tie. Null keys are keys."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new.withColumn("_new", F.lit(1)) if old is None else old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        best = both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(order, "_new")).alias("_row"))
        return best.select("_row.*").drop("_new")

    return merge


def replacing(*key: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for write(): delete, then insert. All old rows with a key of the new ones go."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new
        gone = new.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        return old.join(gone, same, "left_anti").unionByName(new)

    return merge


class BucketTable:
    """A table at a path that all executors reach. Its key and number of buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        folder = self._at("versions")
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict | None:
        """schema, key, buckets, folders (bucket: folder), batches (writer: number of its last batch)."""
        known = self.versions()
        if not known:
            return None
        name = f"v{known[-1] if version is None else version:012d}"
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{name}").first()[0])

    def create(self, schema: StructType, key: list[str], buckets: int = 64) -> BucketTable:
        """An empty table, unless there is one."""
        if not self.versions():
            self._publish(0, {"schema": schema.json(), "key": key, "buckets": buckets, "folders": {}, "batches": {}})
        return self

    def _publish(self, version: int, manifest: dict) -> None:
        try:
            out = self._fs.create(self._at("versions", f"v{version:012d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} of {self.path} was made by another writer") from e
            raise
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"there is no table at {self.path}")
        folders = [f for b, f in sorted(m["folders"].items()) if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def write(self, rows: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """The version with the rows merged in (the present one, where they change nothing). batch: the writer's name and
        the batch's number; numbers of a writer go up, and one that is not above its last is in the table already."""
        m, known = self.manifest(), self.versions()
        if m is None:
            raise ValueError(f"there is no table at {self.path}")
        if batch and batch[1] <= m["batches"].get(batch[0], -1):
            return known[-1]
        schema = StructType.fromJson(json.loads(m["schema"]))
        bucket = F.pmod(F.xxhash64(*m["key"]), F.lit(m["buckets"])).cast("int")
        new = rows.select(*schema.fieldNames())
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # as many as buckets at most
        if touched:
            held = [b for b in touched if str(b) in m["folders"]]
            merged = merge(self.read(known[-1], held) if held else None, new)
            folder = f"data/{uuid.uuid4().hex}"
            merged.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            made = {b for b in touched if self._fs.exists(self._at(folder, f"_bucket={b}"))}
            folders = {b: f for b, f in m["folders"].items() if int(b) not in touched}
            m["folders"] = folders | {str(b): f"{folder}/_bucket={b}" for b in made}
        if batch:
            m["batches"][batch[0]] = batch[1]
        if touched or batch:
            self._publish(known[-1] + 1, m)
        return self.versions()[-1]

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions, and the folders that those don't name. Readers of older versions
        must have ended, and no write may run. How many folders were deleted."""
        known = self.versions()
        used = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._at("versions", f"v{v:012d}"), False)
        folder = self._at("data")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        live = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        for name in names:
            if name not in used:
                gone += bool(self._fs.delete(self._at("data", name), True))
                continue
            for part in self._fs.listStatus(self._at("data", name)):  # buckets that were rewritten since
                inner = part.getPath().getName()
                if inner.startswith("_bucket=") and f"data/{name}/{inner}" not in live:
                    gone += bool(self._fs.delete(part.getPath(), True))
        return gone
