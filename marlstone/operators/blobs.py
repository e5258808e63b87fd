"""Large values kept in files of their own, named by their content."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store


class Blobs:
    """A folder of blobs; equal content is kept once, and reading never changes anything."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def put(self, data: bytes) -> str:
        name = hashlib.sha256(data).hexdigest()
        if not self.store.exists(name):
            self.store.put_bytes(name, data, overwrite=True)
        return name

    def get(self, name: str) -> bytes:
        if not self.store.exists(name):
            raise KeyError(f"no such blob: {name}")
        return self.store.get_bytes(name)

    def delete(self, name: str) -> None:
        self.store.delete(name)

    def rows(self) -> DataFrame:
        """(name, size, content) of all blobs, read by Spark."""
        found = self.spark.read.format("binaryFile").load(self.store.root)
        found = found.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), "content")
        empty = hashlib.sha256(b"").hexdigest()  # Spark's reader leaves out empty files
        return found.union(self.spark.createDataFrame([(empty, 0, bytearray())], found.schema)) if self.store.exists(empty) else found
