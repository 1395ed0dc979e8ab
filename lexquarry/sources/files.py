"""File operations on whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexquarry.errors import IndexIOError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name) or not self._fs.getFileStatus(self._path(name)).isDirectory():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def is_directory(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._path(name)).isDirectory()

    def modified(self, name: str) -> int:
        """Milliseconds since 1970."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not exist yet; of two writers one fails."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            raise IndexIOError(f"{self.root}/{name} was written by someone else") from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
