"""Shards from a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (bucket of a hash of the row, id, checksum, size). A keyed
Feistel network permutes the next power of four; values of N and more walk along their cycle
until they fall below N, so the result is a permutation of 0..N-1. Position p then lies in shard
p mod S at slot p div S: shard sizes differ by one at most, and both ways are computable.

Nulls: a null text counts as no bytes, a null id is numbered like any other, and many of them are
spread over the buckets by their texts. Repeated rows get one number each, so equal rows are the only
ones that meet in a bucket. Texts of any length count in full; only their size and checksum are moved.
An empty table gives no rows. Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix

#: Buckets of the row numbering: bounds what the driver gathers (one count for each).
BUCKETS = 4096
ROUNDS = 6


def _half(n: int) -> int:
    """Bits of half a block: the smallest even split that holds n values."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _pass(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    if back:
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
    else:
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Position of each row number below n, or with back the row number at each position."""
    half, keys = _half(n), _keys(seed)
    out = _pass(np.asarray(rows, dtype=np.uint64), half, keys, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _pass(out[far], half, keys, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = 0) -> int:
    """Global row number that lies at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(docs: DataFrame, order: list[str], bucket_of: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """docs with `row_no` 0..N-1, and N; only one count for each bucket reaches the driver."""
    bucket = F.pmod(F.xxhash64(*bucket_of), F.lit(buckets)).cast("int").alias("bucket")
    counts = {r[0]: r[1] for r in docs.select(bucket).groupBy("bucket").count().collect()}
    start, at = [], 0
    for b in range(buckets):
        start.append((b, at))
        at += counts.get(b, 0)
    starts = docs.sparkSession.createDataFrame(start, "bucket int, first long")
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    out = docs.withColumn("bucket", bucket).withColumn("within", within).join(F.broadcast(starts), "bucket")
    return out.withColumn("row_no", F.col("first") + F.col("within")).drop("bucket", "within", "first"), at


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no) for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lean = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    numbered, n = number_rows(lean, ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    at = numbered.withColumn("at", position("row_no"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("at") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
