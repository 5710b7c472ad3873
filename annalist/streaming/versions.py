"""A table in versions: data is written first, then a manifest whose name can be taken only once makes it the next version.

Two writers that start from the same version race for one name; the later one gets a Conflict and has changed
nothing. Readers see whole versions only. All files lie below one folder of a store that Spark can reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version long, parent long, data string"


class Conflict(Exception):
    """Another writer has made the version that this one was to be."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _store(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        store, p = self._store(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def head(self) -> int:
        """The latest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:020d}.json", wholetext=True).first()["value"])

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{self.manifest(self.head() if version is None else version)['data']}")

    def commit(self, df: DataFrame, expected: int) -> int:
        """Write df as the version after expected; Conflict if that is not the latest any more."""
        if self.head() != expected:
            raise Conflict(f"expected version {expected}, found {self.head()}")
        data = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{data}")
        store, p = self._store(f"{self.root}/manifests/{expected + 1:020d}.json")
        try:
            out = store.create(p, False)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            raise Conflict(f"version {expected + 1} was made by another writer") from e
        out.write(bytearray(json.dumps({"version": expected + 1, "parent": expected, "data": data}).encode()))
        out.close()
        return expected + 1

    def put(self, rows: DataFrame, keys: list[str], expected: int, deleted: str | None = None) -> int:
        """A version with rows in place of those with the same keys; rows marked deleted go."""
        new = rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows
        if expected:
            new = self.read(expected).join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(new)
        return self.commit(new, expected)

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 3) -> int:
        """Commit change(the latest data, None at first); after a Conflict change is applied anew to what the other writer made."""
        for left in range(tries, 0, -1):
            head = self.head()
            try:
                return self.commit(change(self.read(head) if head else None), head)
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("no tries")

    def collect_garbage(self, keep: int = 1) -> int:
        """Remove data that none of the latest keep versions has, with their manifests; how many folders went. No writer may be at work."""
        kept = sorted(self.versions())[-keep:]
        used = {self.manifest(v)["data"] for v in kept}
        gone = [n for n in self._names("data") if n not in used]
        for v in self.versions():
            if v not in kept:
                store, p = self._store(f"{self.root}/manifests/{v:020d}.json")
                store.delete(p, False)
        for n in gone:
            store, p = self._store(f"{self.root}/data/{n}")
            store.delete(p, True)
        return len(gone)

    def clear(self) -> None:
        """No versions, no data."""
        store, p = self._store(self.root)
        store.delete(p, True)
