"""File operations through Hadoop's file system, on whatever store a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The few file operations needed, on whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(path))] if self.fs.exists(self.at(path)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, text: str, path: str) -> None:
        """Written beside and renamed; fails if the name is taken."""
        draft = self.at(path + ".draft")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(path)) or not self.fs.rename(draft, self.at(path)):
            raise RuntimeError(f"{path} has been published by someone else")

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)
