"""A table of unique keys that can be changed: hash buckets of parquet files and a manifest for each version.

A change reads only the buckets that its keys fall in, writes new files for these beside the old ones, and then writes the
next manifest, which names the files of every bucket.  A reader takes the newest manifest and the files it names, so it
sees one version whole; a change that fails leaves files that no manifest names, and the version before stays.  Manifests
have a row for each bucket and addition, so they grow with the buckets, not with the table.  Changes of one table are made
one after another: a version that another writer has made meanwhile is an error, and the change may be tried again.

Marks make changes repeatable: a change that comes with a name and a number no larger than that name's last one does
nothing, as when a stream sends a batch again.  Null keys are a key; a change with no rows makes no version.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = re.compile(r"v(\d{12})\.json$")
BUCKET = "_bucket"
#: Changed keys that may be broadcast.
FEW = 200_000
#: Files of a bucket that additions may leave before an addition writes the bucket anew.
PARTS = 8


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self.files = self.at("x").getFileSystem(conf)
        self.copied = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """A table of these rows, one for each key; a larger table takes more buckets, so that one stays a task's work."""
        table = cls(rows.sparkSession, path)
        if table.newest():
            raise FileExistsError(path)
        table.write_manifest({"version": 0, "key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "files": {}, "marks": {}})
        table.insert_new(rows)
        return table

    # Manifests

    def versions(self) -> list[int]:
        top = self.at("versions")
        found = (MANIFEST.search(s.getPath().getName()) for s in self.files.listStatus(top)) if self.files.exists(top) else ()
        return sorted(int(m[1]) for m in found if m)

    def newest(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.newest() if version is None else version
        stream = self.files.open(self.at(f"versions/v{version:012d}.json"))
        try:
            return json.loads(self.copied(stream))
        finally:
            stream.close()

    def write_manifest(self, manifest: dict) -> None:
        """The manifest under a name of its own, then renamed: it appears whole or not at all."""
        final, fresh = self.at(f"versions/v{manifest['version']:012d}.json"), self.at(f"versions/.{uuid.uuid4().hex}")
        out = self.files.create(fresh, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self.files.exists(final) or not self.files.rename(fresh, final):
            self.files.delete(fresh, False)
            raise RuntimeError(f"another change has made version {manifest['version']}")

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        return self.of_buckets(self.manifest(version))

    def of_buckets(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or all, of a version."""
        schema = StructType.fromJson(manifest["schema"])
        held = manifest["files"]
        paths = [f"{self.path}/{f}" for b in (held if buckets is None else map(str, buckets)) for f in held.get(b, ())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Changes

    def bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(manifest["key"]), F.lit(manifest["buckets"])).cast("int")

    def changed(self, rows: DataFrame, mark: tuple[str, int] | None, change: Callable, notes: dict[str, int] | None = None) -> int | None:
        """Make the next version by a change of the buckets that rows fall in; its number, or None if nothing is to be done.

        notes: further marks to be kept with it.  change(manifest, staged rows, touched buckets) gives (rows to write, whether they come instead of the buckets' old rows)."""
        manifest = self.manifest()
        if mark and manifest["marks"].get(mark[0], -1) >= mark[1]:
            return None
        staged_at = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged_at)
        staged = self.spark.read.schema(rows.schema).parquet(staged_at)
        touched = sorted(r[0] for r in staged.select(self.bucket(manifest)).distinct().collect())  # at most the buckets
        try:
            if not touched and not mark:
                return None
            files, marks = dict(manifest["files"]), dict(manifest["marks"])
            if touched:
                out, instead = change(manifest, staged, touched)
                folder = f"data/{uuid.uuid4().hex}"
                dealt = out.select(*StructType.fromJson(manifest["schema"]).names).withColumn(BUCKET, self.bucket(manifest)).repartition(F.col(BUCKET))
                dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
                written = {int(s.getPath().getName().split("=")[1]): f"{folder}/{s.getPath().getName()}" for s in self.files.listStatus(self.at(folder)) if "=" in s.getPath().getName()}
                for b in touched:
                    files[str(b)] = ([] if instead else files.get(str(b), [])) + ([written[b]] if b in written else [])
            if mark:
                marks |= {mark[0]: mark[1], **(notes or {})}
            self.write_manifest({**manifest, "version": manifest["version"] + 1, "files": {b: f for b, f in files.items() if f}, "marks": marks})
            return manifest["version"] + 1
        finally:
            self.files.delete(self.at(f"staged/{staged_at.rpartition('/')[2]}"), True)

    def insert_new(self, rows: DataFrame, order: str | None = None, mark: tuple[str, int] | None = None) -> int | None:
        """Add a row for each key that the table lacks, the first by order; the files of a bucket are added to, and written
        anew once they are many."""

        def added(manifest, staged, touched):
            key = manifest["key"]
            first = staged.groupBy(key).agg(F.min_by(F.struct(*staged.columns), order or key).alias("_row")).select("_row.*") if order else staged.dropDuplicates([key])
            old = self.of_buckets(manifest, touched)
            fresh = first.join(old.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
            many = any(len(manifest["files"].get(str(b), ())) >= PARTS for b in touched)
            return (old.unionByName(fresh), True) if many else (fresh, False)

        return self.changed(rows, mark, added)

    def combine(self, rows: DataFrame, merged: dict[str, Callable], mark: tuple[str, int] | None = None, notes: dict[str, int] | None = None) -> int | None:
        """One row for each key of the table and of rows, each other column made of all of its values by an aggregate."""

        def together(manifest, staged, touched):
            key = manifest["key"]
            both = self.of_buckets(manifest, touched).unionByName(staged)
            return both.groupBy(key).agg(*[f(c).alias(c) for c, f in merged.items()]), True

        return self.changed(rows, mark, together, notes)

    def delete(self, keys: DataFrame, mark: tuple[str, int] | None = None) -> int | None:
        """Drop the rows of these keys; keys: a table with the key's column."""

        def left(manifest, staged, touched):
            key = manifest["key"]
            gone = staged.distinct()
            gone = F.broadcast(gone) if gone.limit(FEW + 1).count() <= FEW else gone
            return self.of_buckets(manifest, touched).join(gone.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti"), True

        return self.changed(keys.select(self.manifest()["key"]), mark, left)

    def rebucket(self, buckets: int) -> int:
        """The same rows in another number of buckets, for a table that has grown."""
        manifest = self.manifest()
        fresh, folder = {**manifest, "version": manifest["version"] + 1, "buckets": buckets, "files": {}}, f"data/{uuid.uuid4().hex}"
        self.read().withColumn(BUCKET, self.bucket(fresh)).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        for s in self.files.listStatus(self.at(folder)):
            if "=" in (name := s.getPath().getName()):
                fresh["files"][name.split("=")[1]] = [f"{folder}/{name}"]
        self.write_manifest(fresh)
        return fresh["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the newest ``keep``, and the files that none of these names; the number of folders deleted."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for files in self.manifest(v)["files"].values() for f in files}
        for v in versions[:-keep]:
            self.files.delete(self.at(f"versions/v{v:012d}.json"), False)
        gone = 0
        for folder in self.files.listStatus(self.at("data")) if self.files.exists(self.at("data")) else ():
            name = folder.getPath().getName()
            for s in self.files.listStatus(folder.getPath()):
                if "=" in s.getPath().getName() and f"data/{name}/{s.getPath().getName()}" not in used:
                    self.files.delete(s.getPath(), True)
                    gone += 1
        return gone
