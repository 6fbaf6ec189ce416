"""Small files and folders through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> bool:
        """Write a new file whole; False if the name is taken. The file appears at once, by renaming."""
        target, draft = self._path(name), self._path(f"{name}.{self._jvm.java.util.UUID.randomUUID()}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
