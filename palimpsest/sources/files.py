"""Small metadata files on any file system that Spark itself can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Reads and writes whole small files by Hadoop's FileSystem, so that a root may be local, HDFS or an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """By another name first, then renamed: a reader sees all of it or nothing."""
        path, staged = self._path(name), self._path(f"{name}.staged")
        self._fs.mkdirs(path.getParent())
        stream = self._fs.create(staged, True)
        stream.write(text.encode())
        stream.close()
        if self._fs.exists(path):
            raise FileExistsError(name)
        if not self._fs.rename(staged, path):
            raise OSError(f"{name} could not be published")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
