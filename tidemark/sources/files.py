"""Small files on whatever file system a path names, by Hadoop's API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class NameTaken(RuntimeError):
    """A file of that name is there already."""


class Files:
    """The files under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def text(self, name: str) -> str | None:
        """A file's text, or None if there is none."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file whose whole text appears at once; NameTaken if there is one."""
        folder, _, _ = name.rpartition("/")
        hidden = f"{folder}/.{uuid.uuid4().hex}".lstrip("/")
        stream = self._fs.create(self._path(hidden), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self._fs.rename(self._path(hidden), self._path(name)):
            self._fs.delete(self._path(hidden), False)
            raise NameTaken(name)

    def names(self, name: str = "") -> list[str]:
        """What is in a folder; nothing if there is none."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self.exists(name) else []

    def paths(self, name: str, suffix: str) -> list[str]:
        """The whole paths of the files in a folder whose names end so."""
        return [s.getPath().toString() for s in self._fs.listStatus(self._path(name)) if s.getPath().getName().endswith(suffix)]

    def size(self, path: str) -> int:
        """The length of a file, by its whole path."""
        return self._fs.getFileStatus(self._jvm.org.apache.hadoop.fs.Path(path)).getLen()

    def rename(self, name: str, other: str) -> None:
        if not self._fs.rename(self._path(name), self._path(other)):
            raise OSError(f"{name} can't be renamed")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
