"""Vector distance, nearest rows, rigid alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("dot", "cosine", "l2sq")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "dot") -> Column:
    """dot: inner product; cosine: 1 - cosine; l2sq: squared distance. Null unless of equal length."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if metric == "dot":
        value = dot(a, b)
    elif metric == "cosine":
        value = 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    else:
        value = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), value)


def half(a: Column) -> Column:
    """Values rounded to 16-bit floats."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).astype(np.float32))

    return run(a)


def nearest(rows: DataFrame, query: list[float], k: int, vector: str, key: str, metric: str = "dot") -> DataFrame:
    """The k rows nearest to one vector; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = distance(F.col(vector), q, metric)
    return rows.withColumn("distance", d).orderBy(F.desc("distance") if metric == "dot" else F.asc("distance"), key).limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, vector: str, key: str, metric: str = "dot", block: int = 1000) -> DataFrame:
    """The k nearest rows of each query (query_id, q), as (query_id, place, key, distance); ties by key.

    Queries are a stated set: about `block` of them at a time are fetched and sent to all tasks, which
    multiply their rows with them batch by batch and each let out at most k rows a query.
    """
    spark, out = rows.sparkSession, None
    blocks = max(1, -(-queries.count() // block))
    for b in range(blocks):
        found = list(queries.select("query_id", "q").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toLocalIterator())
        ids = np.array([r["query_id"] for r in found])
        matrix = np.array([r["q"] for r in found], dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def top(parts, shared=shared):
            ids, matrix = shared.value
            keys: list = [[] for _ in ids]
            far: list = [np.zeros(0) for _ in ids]
            for part in parts:
                if not len(ids) or not len(part):
                    continue
                m, own = np.stack(part[vector].to_numpy()).astype(np.float64), part[key].to_numpy()
                if metric == "dot":
                    d = -(m @ matrix.T)
                elif metric == "cosine":
                    d = 1 - (m @ matrix.T) / (np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(matrix, axis=1))
                else:
                    d = (m**2).sum(1)[:, None] - 2 * m @ matrix.T + (matrix**2).sum(1)
                edge = np.partition(d, k - 1, axis=0)[k - 1] if k < len(d) else np.full(len(ids), np.inf)
                for j in range(len(ids)):
                    pick = np.flatnonzero(d[:, j] <= edge[j])  # with all ties of the k-th
                    near, who = np.concatenate([far[j], d[pick, j]]), np.concatenate([keys[j], own[pick]]) if len(keys[j]) else own[pick]
                    best = np.lexsort((who, near))[:k]
                    far[j], keys[j] = near[best], who[best]
            if any(len(x) for x in far):
                yield pd.DataFrame({"query_id": np.repeat(ids, [len(x) for x in far]), key: np.concatenate([x for x in keys if len(x)]), "d": np.concatenate(far)})

        one = rows.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(top, f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(rows.dtypes)[key]}, d double")
        out = one if out is None else out.union(one)
    w = Window.partitionBy("query_id").orderBy("d", key)
    sign = -1.0 if metric == "dot" else 1.0
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", key, (F.col("d") * sign).alias("distance"))


def rigid_rmsd(a: Column, b: Column, align: bool = True) -> Column:
    """Root mean square deviation of two 3-D point lists, after the best rotation if align."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q) -> float:
            p, q = np.asarray(p, float).reshape(-1, 3), np.asarray(q, float).reshape(-1, 3)
            if align:
                p, q = p - p.mean(0), q - q.mean(0)
                u, _, v = np.linalg.svd(p.T @ q)
                turn = np.diag([1, 1, np.sign(np.linalg.det(u @ v))])
                p = p @ u @ turn @ v
            return float(np.sqrt(((p - q) ** 2).sum(1).mean()))

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)
