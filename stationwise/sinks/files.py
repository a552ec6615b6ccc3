"""Small files and folders in whatever store Spark writes to, through Hadoop's file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system that a path lives in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._system.exists(self._path(self.at(name)))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none where there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self._system.listStatus(self._path(self.at(folder))))

    def delete(self, name: str) -> None:
        self._system.delete(self._path(self.at(name)), True)

    def rename(self, old: str, new: str) -> bool:
        target = self._path(self.at(new))
        self._system.mkdirs(target.getParent())
        return self._system.rename(self._path(self.at(old)), target)

    def put_new(self, name: str, content: dict) -> bool:
        """Store a small JSON file whole; False, and nothing written, where the name is taken.

        It is written under another name first, so no reader sees half of it.
        """
        if self.exists(name):
            return False
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        out = self._system.create(self._path(self.at(draft)), False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if not self.exists(name) and self.rename(draft, name):
            return True
        self.delete(draft)
        return False

    def get(self, name: str) -> dict:
        """The content of a small JSON file."""
        stream = self._system.open(self._path(self.at(name)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)
