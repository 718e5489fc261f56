"""Several tables kept together in versions: a reader sees all of one version or none of it."""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has made the version that was to be made."""


class Store:
    """Tables under a path; each version has a folder and, once it is whole, a file in the folder of manifests.

    What reads a version isn't disturbed by those that are made later; drop()
    removes old ones.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def versions(self) -> list[int]:
        fs, place = self._fs(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(place)) if fs.exists(place) else []

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the newest version, or of another."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/versions/{version}/{name}")

    def write(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Make a version of all its tables; after is the version that they were made from, if any.

        Raises Conflict if another version was made since.  A writer that dies
        leaves no version, only files that nobody reads.
        """
        last = (self.versions() or [-1])[-1]
        if after is not None and last != after:
            raise Conflict(f"version {last} was made after {after}")
        version = last + 1
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.path}/versions/{version}/{name}")
        fs, place = self._fs(f"{self.path}/manifests/{version}")
        try:
            fs.create(place, False).close()  # fails if it is there
        except Py4JJavaError as e:
            raise Conflict(f"version {version} was made by another writer") from e
        return version

    def drop(self, keep: int = 2) -> None:
        """Remove all but the newest versions, manifests first."""
        for version in self.versions()[:-keep]:
            for folder in ("manifests", "versions"):
                fs, place = self._fs(f"{self.path}/{folder}/{version}")
                fs.delete(place, True)
