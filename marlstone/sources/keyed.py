"""An ordered key-value map as a DataFrame of (key, value) with distinct binary keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyValues:
    """Each change gives a new map, so a transaction is a chain that is kept or dropped."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def put(self, new: DataFrame, overwrite: bool = True) -> KeyValues:
        """Adds rows; existing keys are replaced, or kept when not overwrite. Of equal new keys one stays."""
        new = new.dropDuplicates(["key"])
        if overwrite:
            return KeyValues(self.rows.join(new, "key", "left_anti").unionByName(new))
        return KeyValues(self.rows.unionByName(new.join(self.rows, "key", "left_anti")))

    def delete(self, keys: DataFrame) -> KeyValues:
        return KeyValues(self.rows.join(keys, "key", "left_anti"))

    def get(self, key: bytes) -> bytes | None:
        found = self.rows.where(F.col("key") == F.lit(key)).select("value").first()
        return bytes(found[0]) if found else None

    def cursor(self, after: bytes | None = None, before: bytes | None = None, most: int | None = None) -> DataFrame:
        """Rows in key order after a key, or in reverse order before one."""
        rows = self.rows.where(F.col("key") > F.lit(after)) if after is not None else self.rows
        rows = rows.where(F.col("key") < F.lit(before)) if before is not None else rows
        rows = rows.orderBy(F.desc("key") if before is not None else F.asc("key"))
        return rows.limit(most) if most is not None else rows

    def count(self) -> int:
        return self.rows.count()
