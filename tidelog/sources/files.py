"""Small files on any file system that Spark reads, through Hadoop's API; the name of a file appears only when it is whole."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root, self.conf, self.gateway = spark._jvm, root.rstrip("/"), spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def mkdirs(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name) if name else self.jvm.org.apache.hadoop.fs.Path(self.root))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def write(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """Writes a temporary file of a name of its own and renames it; fails if the name exists, unless it may be overwritten.  Of two
        writers of one name the file system lets one rename succeed (atomically where it does so itself, as HDFS)."""
        tmp = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        if overwrite and self.exists(name):
            self.fs.delete(self.path(name), False)
        try:
            self._rename(tmp, self.path(name))
        except Py4JJavaError as error:
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise FileExistsError(name) from None
            raise

    def _rename(self, source, target) -> None:
        """FileContext's rename fails if the target exists; the one of FileSystem may replace it."""
        hadoop = self.jvm.org.apache.hadoop
        context = hadoop.fs.FileContext.getFileContext(source.getFileSystem(self.conf).getUri(), self.conf)
        context.rename(source, target, self.gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 0))

    def copy(self, name: str, target: str) -> None:
        """Copies a file or folder to another path, byte by byte; it never becomes a frame."""
        at = self.jvm.org.apache.hadoop.fs.Path(target)
        there = at.getFileSystem(self.conf)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), there, at, False, True, self.conf)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
