"""A table in buckets whose versions share what did not change.

A version is a manifest: for each bucket the batch that wrote it last. An update writes the touched buckets next to the
old ones and then commits its manifest with one rename, so a failed write is never seen. A batch that is committed
already changes nothing when it is repeated; one that was not starts again from the version before it. Only the newest
``KEPT`` versions stay, with the buckets they name. Manifests have one entry per bucket, and no data rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: versions that remain after a commit
KEPT = 2
BUCKET = "bucket"


def part_of(key: Column, parts: int) -> Column:
    """The name of the hash part of a key."""
    return F.lpad(F.pmod(F.xxhash64(key), F.lit(parts)).cast("string"), 4, "0")


def write_text(files, path, text: str) -> None:
    """A small file, through the session's own file system."""
    out = files.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _names(self, *names: str) -> list[str]:
        where = self._path(*names)
        return [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []

    def versions(self) -> list[int]:
        """Committed batches, ascending."""
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def newest(self, before: int | None = None) -> int | None:
        known = [v for v in self.versions() if before is None or v < before]
        return known[-1] if known else None

    def manifest(self, version: int | None) -> dict[str, int]:
        """The batch that wrote each bucket of a version; empty for none."""
        if version is None:
            return {}
        stream = self._files.open(self._path("manifest", f"{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None, wanted: Callable[[str], bool] = lambda _: True) -> DataFrame:
        """The rows of a version, or of its ``wanted`` buckets only: other buckets are not opened."""
        paths = [f"{self.path}/data/batch={batch}/{BUCKET}={bucket}" for bucket, batch in self.manifest(version).items() if wanted(bucket)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def commit(self, rows: DataFrame, touched: Iterable[str], batch: int, dropped: Callable[[str], bool] = lambda _: False) -> None:
        """A version in which the ``touched`` buckets hold ``rows`` (with their bucket) and all others what they held before.

        Small buckets share a task and large ones are split among several. Buckets that are left without rows and those that are
        ``dropped`` leave the manifest.
        """
        if batch in self.versions():
            return
        names = (StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema).names
        rows.select(*names, BUCKET).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/batch={batch}")
        written = {n.removeprefix(f"{BUCKET}=") for n in self._names("data", f"batch={batch}") if n.startswith(f"{BUCKET}=")}
        touched = set(touched)
        entries = {b: v for b, v in self.manifest(self.newest(batch)).items() if b not in touched} | {b: batch for b in written}
        self._publish(batch, {b: v for b, v in sorted(entries.items()) if not dropped(b)})
        self._clean()

    def _publish(self, batch: int, entries: dict[str, int]) -> None:
        write_text(self._files, self._path("manifest", f"{batch}.draft"), json.dumps(entries))
        if not self._files.rename(self._path("manifest", f"{batch}.draft"), self._path("manifest", f"{batch}.json")):
            raise RuntimeError(f"version {batch} of {self.path} could not be committed")

    def _clean(self) -> None:
        """Removes manifests behind the newest ``KEPT`` and what no remaining one names."""
        versions = self.versions()
        for version in versions[:-KEPT]:
            self._files.delete(self._path("manifest", f"{version}.json"), False)
        named = {(f"batch={v}", f"{BUCKET}={b}") for version in versions[-KEPT:] for b, v in self.manifest(version).items()}
        for folder in self._names("data"):
            inside = [n for n in self._names("data", folder) if n.startswith(f"{BUCKET}=")]
            unnamed = [n for n in inside if (folder, n) not in named]
            if int(folder.removeprefix("batch=")) > versions[-1]:
                continue  # an update under way
            for name in unnamed:
                self._files.delete(self._path("data", folder, name), True)
            if len(unnamed) == len(inside):
                self._files.delete(self._path("data", folder), True)


def buckets_of(rows: DataFrame) -> list[str]:
    """The buckets that occur; as many names as buckets at most."""
    return [r[0] for r in rows.select(BUCKET).distinct().collect()]
