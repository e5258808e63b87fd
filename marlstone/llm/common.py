"""Shared helpers: staging tables, word hashing, label propagation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Rows in one Arrow batch: texts may be long, so far fewer than Spark's default.
BATCH_ROWS = 1000
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured, a local session gets one of its own;
    on a cluster that would be a folder of one machine, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of Python workers by the rows of an Arrow batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Staging:
    """Tables written to the shared folder; cuts lineage and survives lost executors. What is not
    dropped earlier goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", 0
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Delete the n-th table once nothing will read it again."""
        path, fs = self._at(f"{self.root}/{n}")
        fs.delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text whose A-Z are lower-cased.

    bytes.lower() changes A-Z only, and bytes.split() splits at x20 and x09-x0D only.
    """
    return np.array(list(map(xxh64_intdigest, text.lower().split())), dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = (out ^ words[i : n - width + 1 + i]) * _A
        out = (out ^ (out >> np.uint64(32))) * _B
    return mix(out)


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over single batches; f is sent to the workers by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def components(spark: SparkSession, edges: DataFrame, staging: Staging, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows hooks twice, and replaces the
    ends of edges by what they hook to; edges within a tree vanish and equal ones become one, so a
    dense group is a single node after the first round and chains shrink geometrically. The hooks
    of all rounds are then followed from the last to the first. Neighbours are reduced by partial
    aggregates; a node with very many edges is split by the adaptive join.
    """
    rounds: list[DataFrame] = []
    left = edges.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).where("a <> b").distinct()
    for _ in range(most):
        left = staging.put(left)
        if left.isEmpty():
            break
        ends = left.select(F.col("p").alias("node"), F.col("q").alias("m")).union(left.select("q", "p"))
        hooks = staging.put(ends.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("to")))
        for _ in range(2):
            then = hooks.select(F.col("node").alias("to"), F.col("to").alias("then"))
            hooks = staging.put(hooks.join(then, "to").select("node", F.col("then").alias("to")))
        rounds.append(hooks)
        ps = hooks.select(F.col("node").alias("p"), F.col("to").alias("p2"))
        qs = hooks.select(F.col("node").alias("q"), F.col("to").alias("q2"))
        moved = left.join(ps, "p").select("q", "p2").join(qs, "q")
        left = moved.select(F.least("p2", "q2").alias("p"), F.greatest("p2", "q2").alias("q")).where("p <> q").distinct()
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    roots = None
    for hooks in reversed(rounds):
        now = hooks.select("node", F.col("to").alias("mid"))
        if roots is None:
            roots = now.select("node", F.col("mid").alias("root"))
        else:
            up = roots.select(F.col("node").alias("mid"), "root")
            roots = now.join(up, "mid", "left").select("node", F.coalesce("root", "mid").alias("root"))
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return staging.put(roots)
