"""Several tables that are published together: readers see all of one refresh or all of another.

Tables are written first, each to a place of its own; then a manifest that names them all is created under the next number, which
succeeds for one writer only. Readers take the manifest with the greatest number. Until it stands nothing of a refresh is seen, and what a
reader has opened stays until ``vacuum`` removes what neither recent manifests name nor a lease protects.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer published since this one began."""


def create(spark: SparkSession, path: str, text: str) -> None:
    """Creates a small file; ``Conflict`` where it exists, so of several writers one succeeds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    except Exception as e:
        raise Conflict(f"{path} was written by another writer") from e
    out.write(bytearray(text.encode()))
    out.close()


class Published:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of all manifests, least first."""
        path, fs = self._path("manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self, number: int | None = None) -> dict[str, str]:
        """Table names and places of a manifest; of the newest, if none is named."""
        found = self.numbers()
        if not found:
            raise FileNotFoundError(f"nothing is published below {self.root}")
        path, _ = self._path(f"manifests/{found[-1] if number is None else number:012d}")
        text = "".join(r.value for r in self.spark.read.text(path.toString(), wholetext=True).collect())  # one small file
        return json.loads(text)

    def stage(self, **tables: DataFrame) -> dict[str, str]:
        """Writes tables where no reader sees them yet: their names and places."""
        out = {}
        for name, df in tables.items():
            out[name] = f"tables/{name}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.root}/{out[name]}")
        return out

    def commit(self, staged: dict[str, str], after: int) -> int:
        """Publishes staged tables beside those that the manifest ``after`` names (0: none); ``Conflict`` if there is a newer one."""
        found = self.numbers()
        if (found[-1] if found else 0) != after:
            raise Conflict(f"{after} was read, and {found[-1] if found else 0} is published")
        named = {**(self.manifest(after) if after else {}), **staged}
        create(self.spark, f"{self.root}/manifests/{after + 1:012d}", json.dumps(named, sort_keys=True))
        return after + 1

    def read(self) -> dict[str, DataFrame]:
        """All tables of the newest manifest; a reader keeps them while newer ones are published."""
        return {name: self.spark.read.parquet(f"{self.root}/{place}") for name, place in self.manifest().items()}

    def vacuum(self, keep: int, lease_seconds: int) -> int:
        """Removes all but the newest ``keep`` manifests, and tables that no manifest left names and that are older than the lease, by the
        time of the file system itself: how many tables went."""
        numbers = self.numbers()
        named = {place for n in numbers[-keep:] for place in self.manifest(n).values()}
        path, fs = self._path("tables")
        mark, _ = self._path(f"now-{uuid.uuid4().hex[:8]}")
        fs.create(mark, False).close()
        now = fs.getFileStatus(mark).getModificationTime()
        fs.delete(mark, False)
        gone = 0
        for f in fs.listStatus(path) if fs.exists(path) else []:
            if f"tables/{f.getPath().getName()}" not in named and now - f.getModificationTime() >= 1000 * lease_seconds:
                fs.delete(f.getPath(), True)
                gone += 1
        for n in numbers[:-keep]:
            fs.delete(self._path(f"manifests/{n:012d}")[0], False)
        return gone
