"""Small files on any store that Hadoop's file systems reach: heads, locks and logs beside tables."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """A folder, given as a URI or a local path."""

    def __init__(self, spark: SparkSession, root: str):
        self._gateway, self._jvm, self.root = spark.sparkContext._gateway, spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self._path("")).toString()
        self.local = self.fs.getScheme() == "file"
        if self.local:  # without checksum files, which a rename would replace a moment later
            self.fs = self.fs.getRawFileSystem()
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        found = self.fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        self.put_bytes(name, text.encode(), overwrite)

    def put_bytes(self, name: str, data: bytes, overwrite: bool = False) -> None:
        out = self.fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get_bytes(self, name: str) -> bytes:
        found = self.fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(found))
        finally:
            found.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file by a rename, so that readers see the old text or the new one."""
        new = f".{name}.{uuid.uuid4().hex}"
        self._put(new, text, False)
        if self.local:
            self.fs.rename(self._path(new), self._path(name))
            return
        fs = self._jvm.org.apache.hadoop.fs
        rename = getattr(fs, "Options$Rename")
        kinds = self._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE
        files = fs.FileContext.getFileContext(self.fs.getUri())
        files.rename(self.fs.makeQualified(self._path(new)), self.fs.makeQualified(self._path(name)), kinds)

    def create(self, name: str, text: str) -> bool:
        """Makes a file unless it is there; whether it was made."""
        try:
            self._put(name, text, False)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def touch(self, name: str) -> None:
        """Sets the time of a file, if it is still there, to now."""
        if self.exists(name):
            self.fs.setTimes(self._path(name), int(time.time() * 1000), -1)

    def age(self, name: str) -> float:
        """Seconds since a file was written, by the store's clock against this one."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def names(self, ending: str) -> list[str]:
        return sorted(n for n in (f.getPath().getName() for f in self.fs.listStatus(self._path(""))) if n.endswith(ending) and not n.startswith("."))
