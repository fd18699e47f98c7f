"""Files of a store through Spark's file systems, so that any path Spark reads can hold one."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """A folder: whole small files, created once and never changed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Compare-and-set: False if the file is there already. It is seen whole or not at all: written aside and renamed, which fails on a name that is taken."""
        aside = f"aside/{uuid.uuid4().hex}"
        self.write(aside, text)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._fs.mkdirs(self._path(name).getParent())
        try:
            context.rename(self._path(aside), self._path(name), none)
        except Exception as e:
            self.delete(aside)
            if "FileAlreadyExists" in str(e) or self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def lines_to(self, name: str, lines) -> None:
        """Lines to one file, as they come; some at a time reach the JVM."""
        stream = self._fs.create(self._path(name), True)
        held, size = [], 0
        try:
            for line in lines:
                held.append(line)
                size += len(line)
                if size > 1 << 20:
                    stream.write(bytearray(("\n".join(held) + "\n").encode()))
                    held, size = [], 0
            if held:
                stream.write(bytearray(("\n".join(held) + "\n").encode()))
        finally:
            stream.close()
