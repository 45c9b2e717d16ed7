"""The run history as a stored table: hash buckets behind a versioned manifest.

A change rewrites the buckets it touches, into a folder of its own, and then writes a manifest that names the newest folder of
every bucket. Readers follow one manifest, so they see all of a change or nothing of it, and earlier versions stay readable.
Buckets that a change does not touch keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from colsight.functions.rows import constant_rows
from colsight.functions.values import column
from colsight.operators import history

_MANIFEST = "bucket int, path string, rows bigint, key string, schema string"


class VersionConflict(RuntimeError):
    """Another writer has made the next version first."""


class RunStore:
    """A stored table with one row per key, changed by one writer at a time and read by any number."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, runs: DataFrame, key: str = "id", buckets: int = 64) -> RunStore:
        """Version 0 of a table in an empty folder. A null key is a bucket value like any other."""
        store = cls(spark, folder)
        schema = runs.schema.json()
        store._commit(0, [(bucket, None, 0, key, schema) for bucket in range(buckets)], runs, key)
        return store

    # ── Reading ──

    def version(self) -> int:
        """The newest complete version."""
        names = [n for n in self._names("manifest") if self._exists(f"manifest/{n}/_SUCCESS")]
        if not names:
            raise FileNotFoundError(f"no run table under {self.folder}")
        return max(int(n[1:]) for n in names)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the newest."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def files(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        manifest = self._manifest(self.version() if version is None else version)
        return {bucket: path for bucket, path, *_ in manifest if path}

    # ── Changes; each returns the new version ──

    def upsert(self, changes: DataFrame, order: str | None = None) -> int:
        """Given fields replace those of known keys (:func:`colsight.operators.history.update`); unknown keys are added."""

        def change(current: DataFrame, key: str) -> DataFrame:
            added = changes.join(current.select(key), key, "left_anti").select(key).distinct()
            return history.update(history.insert(current, added), changes, key, order)

        return self._change(change, self._buckets_of(changes))

    def delete(self, ids: DataFrame) -> int:
        return self._change(lambda current, key: history.delete(current, ids, key), self._buckets_of(ids))

    def retain(self, hours: int, now: Column) -> int:
        """Drops finished runs older than ``hours``."""
        key = self._manifest(self.version())[0][3]
        everything = self.read()
        gone = everything.join(history.retained(everything, hours, now).select(key), key, "left_anti")
        return self._change(lambda current, _: history.retained(current, hours, now), self._buckets_of(gone))

    def mark_interrupted(self, now: Column, with_detecting: bool = False) -> int:
        """Unfinished runs become failed."""
        states = history.UNFINISHED + history.DETECTING if with_detecting else history.UNFINISHED
        stale = self.read().where(F.col("status").isin(*states))
        return self._change(lambda current, _: history.mark_interrupted(current, now, with_detecting), self._buckets_of(stale))

    # ── Folders and manifests ──

    def _names(self, folder: str) -> list[str]:
        if not self._exists(folder):
            return []
        path = self._path(folder)
        return [s.getPath().getName() for s in path.getFileSystem(self._hadoop()).listStatus(path)]

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self._hadoop()).exists(path)

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _hadoop(self):  # noqa: ANN202
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _manifest(self, version: int) -> list[tuple]:
        frame = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v{version:010d}")
        return sorted(tuple(r) for r in frame.collect())  # one row per bucket

    def _rows(self, manifest: list[tuple]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest[0][4]))
        paths = [f"{self.folder}/{path}" for _, path, *_ in manifest if path]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(column(key)), F.lit(buckets)).cast("int")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        manifest = self._manifest(self.version())
        return [r[0] for r in rows.select(self._bucket(manifest[0][3], len(manifest))).distinct().collect()]  # at most all buckets

    def _change(self, change: Callable[[DataFrame, str], DataFrame], touched: list[int]) -> int:
        base = self.version()
        manifest = self._manifest(base)
        key = manifest[0][3]
        held = [row for row in manifest if row[0] in set(touched)]
        kept = [row for row in manifest if row[0] not in set(touched)]
        if not held:
            return base
        renewed = change(self._rows(held), key)
        return self._commit(base + 1, kept + [(bucket, None, 0, key, schema) for bucket, *_, schema in held], renewed, key, [row[0] for row in held])

    def _commit(self, version: int, manifest: list[tuple], rows: DataFrame, key: str, touched: list[int] | None = None) -> int:
        """Writes the buckets of ``rows`` and then the manifest, in which they replace those without a folder."""
        name = f"manifest/v{version:010d}"
        if self._exists(f"{name}/_SUCCESS"):
            raise VersionConflict(f"version {version} of {self.folder} is there already")
        attempt = uuid.uuid4().hex[:8]
        data = f"data/v{version:010d}-{attempt}"
        placed = rows.withColumn("_bucket", self._bucket(key, len(manifest)))
        if touched is not None:
            placed = placed.where(F.col("_bucket").isin(touched))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{data}")
        counts = {}
        if any(n.startswith("_bucket=") for n in self._names(data)):
            counts = dict(self.spark.read.parquet(f"{self.folder}/{data}").groupBy("_bucket").count().collect())  # one row per bucket
        entries = [
            (bucket, f"{data}/_bucket={bucket}", counts[bucket], key, schema) if bucket in counts else (bucket, path, n, key, schema)
            for bucket, path, n, key, schema in manifest
        ]
        try:
            constant_rows(self.spark, sorted(entries, key=lambda e: e[0]), _MANIFEST).coalesce(1).write.parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            raise VersionConflict(f"version {version} of {self.folder} is being written by another") from error
        return version
