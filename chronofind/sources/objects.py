"""Object store client on Hadoop file systems, for whatever address Spark itself can open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from chronofind.session import filesystem


@dataclass(frozen=True)
class ObjectInfo:
    path: str
    size: int
    modified_ms: int


class ObjectStore:
    """Objects below a root. Listings are complete, however many pages the store answers in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> tuple[object, object]:
        return filesystem(self.spark, f"{self.root}/{name}".rstrip("/"))

    def metadata(self, name: str) -> ObjectInfo | None:
        """Size and time of an object or folder, None where there is none."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        s = fs.getFileStatus(path)
        return ObjectInfo(s.getPath().toString(), s.getLen(), s.getModificationTime())

    def list_files(self, prefix: str = "") -> list[ObjectInfo]:
        """All objects below a folder, in order of their paths; none where it doesn't exist."""
        fs, path = self._at(prefix)
        found = []
        if fs.exists(path):
            statuses = fs.listFiles(path, True)
            while statuses.hasNext():
                s = statuses.next()
                found.append(ObjectInfo(s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found, key=lambda o: o.path)

    def list_folders(self, prefix: str = "") -> list[str]:
        """Names of the folders directly below a folder."""
        fs, path = self._at(prefix)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def upload(self, local: str, name: str) -> None:
        """Copy a local file; readers see it when it is complete."""
        fs, path = self._at(name)
        fs.mkdirs(path.getParent())
        draft = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{path.getName()}.upload")
        fs.copyFromLocalFile(False, True, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), draft)
        fs.delete(path, False)
        fs.rename(draft, path)

    def download(self, name: str, local: str) -> None:
        fs, path = self._at(name)
        fs.copyToLocalFile(False, path, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)

    def delete(self, name: str) -> bool:
        """Delete an object or folder; whether there was one."""
        fs, path = self._at(name)
        return fs.delete(path, True)
