"""Applying feature changes as they arrive to a table in buckets.

The table is a folder: ``data/<version>/bucket=<k>`` has the features whose hashed id falls in bucket ``k``,
and ``manifests/<version>`` names the version that each bucket has last been written in. A micro-batch
writes the buckets that its changes touch and a manifest, in that order; a batch that is run again starts
from the manifest before its own and writes the same again. Readers go by one manifest, so they never see
half a batch. What no kept manifest names is removed. A batch without changes writes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from lotline.operators.upserts import apply_feature_diff

BUCKETS = 64
#: Versions that stay readable: a reader that began with one of them finds its files.
KEPT_VERSIONS = 2
_FIRST = 0


def _name(version: int) -> str:
    return f"{version:012d}"


@dataclass(frozen=True)
class Manifest:
    """``written`` has the version of each bucket that is not empty: as many entries as buckets at most."""

    version: int
    buckets: int
    schema: str
    written: dict[str, int]


@dataclass(frozen=True)
class BucketTable:
    """A feature table in buckets below a folder."""

    spark: SparkSession
    folder: str

    def _files(self, path: str):  # noqa: ANN202
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _listed(self, path: str) -> list[str]:
        files, hadoop = self._files(path)
        return sorted(f.getPath().getName() for f in files.listStatus(hadoop)) if files.exists(hadoop) else []

    def versions(self) -> list[int]:
        """Versions with a whole manifest, oldest first."""
        return [int(v) for v in self._listed(f"{self.folder}/manifests") if "_SUCCESS" in self._listed(f"{self.folder}/manifests/{v}")]

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions())
        text = self.spark.read.text(f"{self.folder}/manifests/{_name(version)}").first()[0]
        return Manifest(**json.loads(text))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The features of a version, the last one if none is named, or of some of its buckets."""
        manifest = self.manifest(version)
        wanted = manifest.written if buckets is None else {k: v for k, v in manifest.written.items() if int(k) in buckets}
        schema = StructType.fromJson(json.loads(manifest.schema))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{_name(v)}/bucket={k}" for k, v in sorted(wanted.items())))

    def _write(self, features: DataFrame, version: int, buckets: int, before: dict[str, int]) -> None:
        """Write features, whose buckets replace those of ``before``, and then the manifest."""
        path = f"{self.folder}/data/{_name(version)}"
        schema = features.schema.json()
        keyed = features.withColumn("bucket", bucket_of(F.col("id"), buckets))
        # One file a bucket: ids are spread evenly whatever they are.
        keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = before | {name.removeprefix("bucket="): version for name in self._listed(path) if name.startswith("bucket=")}
        text = json.dumps({"version": version, "buckets": buckets, "schema": schema, "written": written})
        manifest = self.spark.createDataFrame([(text,)], "value string").coalesce(1)
        manifest.write.mode("overwrite").text(f"{self.folder}/manifests/{_name(version)}")

    def create(self, features: DataFrame, buckets: int = BUCKETS) -> None:
        """Begin the table with the features ``id, geometry, properties``; ids are unique."""
        if self.versions():
            raise ValueError(f"There is a table at {self.folder}")
        self._write(features.select("id", "geometry", "properties"), _FIRST, buckets, {})

    def apply(self, changes: DataFrame, batch_id: int) -> list[int]:
        """Apply the changes of one batch; the buckets that were rewritten. Running a batch again changes nothing."""
        version = batch_id + 1 + _FIRST
        manifest = self.manifest(max(v for v in self.versions() if v < version))
        everything = F.col("op") == "remove_all"
        bucket = F.when(everything, F.lit(-1)).otherwise(bucket_of(F.col("id"), manifest.buckets))
        # As many rows as buckets, and one.
        touched = {r.bucket for r in changes.filter(everything | F.col("id").isNotNull()).select(bucket.alias("bucket")).distinct().collect()}
        if not touched:
            return []
        rewritten = sorted(range(manifest.buckets) if -1 in touched else touched)
        now = apply_feature_diff(self.read(manifest.version, rewritten), changes)
        self._write(now, version, manifest.buckets, {k: v for k, v in manifest.written.items() if int(k) not in rewritten})
        self._tidy()
        return rewritten

    def _tidy(self) -> None:
        """Remove old manifests and the buckets that none of the others names."""
        kept = self.versions()[-KEPT_VERSIONS:]
        for version in self.versions():
            if version not in kept:
                self._remove(f"{self.folder}/manifests/{_name(version)}")
        needed = {(v, k) for m in map(self.manifest, kept) for k, v in m.written.items()}
        for name in self._listed(f"{self.folder}/data"):
            buckets = [b for b in self._listed(f"{self.folder}/data/{name}") if b.startswith("bucket=")]
            unused = [b for b in buckets if (int(name), b.removeprefix("bucket=")) not in needed]
            if len(unused) == len(buckets) and int(name) not in kept:
                self._remove(f"{self.folder}/data/{name}")
            else:
                for b in unused:
                    self._remove(f"{self.folder}/data/{name}/{b}")

    def _remove(self, path: str) -> None:
        files, hadoop = self._files(path)
        files.delete(hadoop, True)


def bucket_of(id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")


def feature_updates(changes: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that applies ``changes`` to the table below ``table``; set a trigger and start it.

    ``changes`` is a stream of change rows whose ``ord`` orders the changes of one batch. The table is
    begun by :meth:`BucketTable.create`.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        BucketTable(batch.sparkSession, table).apply(batch.persist(), batch_id)
        batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
