"""Language identification by sparse multinomial logistic regression on character n-grams.

Counts of hashed character 1- to 3-grams of the whole, lower-cased text are weighted by inverse
document frequency and scaled to unit length. Weights are trained with follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties) on a bounded sample of labelled rows (TRAIN_ROWS, least
hashes of the id); the last fifth of the sample sets the temperature that scales scores.

A null text, or one without a letter, is `und` with score 0, as is every text when there is no
labelled row. Ties go to the language that sorts first. Repeated rows are judged alike; columns
other than id and text are not read for a prediction. Texts of any length are counted whole. An empty
table gives no rows; rows without id are judged, and are never among the held-out ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, map_arrow, small_batches

#: Bounds of the fit: labelled rows, and hashed features as a power of two.
TRAIN_ROWS, FEATURE_BITS, EPOCHS = 2500, 14, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def gram_counts(text: str, bits: int = FEATURE_BITS) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of code points; white space counts as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    total = np.zeros(1 << bits, dtype=np.int64)
    h = np.zeros(len(codes), dtype=np.uint32)
    for k, prime in enumerate(_PRIMES):
        if len(codes) <= k:
            break
        h = (h[: len(codes) - k] ^ codes[k:]) * prime
        h ^= h >> np.uint32(15)
        total += np.bincount(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64), minlength=1 << bits)
    return total


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x @ self.weights / max(float(np.sqrt(x @ x)), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(gram_counts(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], size: int, seed: int = 3) -> Model:
    """rows: (feature numbers, counts, language number), in a random order."""
    df = np.zeros(size)
    for at, _, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    k = len(langs)
    z, n, bz, bn = np.zeros((size, k)), np.zeros((size, k)), np.zeros(k), np.zeros(k)

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    cut = len(rows) - len(rows) // 5
    ready = []
    for at, counts, y in rows:
        x = np.log1p(counts) * idf[at]
        ready.append((at, x / max(float(np.sqrt(x @ x)), 1e-12), y))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(cut):
            at, x, y = ready[i]
            w, b = weights(z[at], n[at]), weights(bz, bn)
            g = softmax(x @ w + b)
            g[y] -= 1
            grad = x[:, None] * g
            sigma = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / ALPHA
            z[at] += grad - sigma * w
            n[at] += grad**2
            bz += g - (np.sqrt(bn + g**2) - np.sqrt(bn)) / ALPHA * b
            bn += g**2
    model = Model(langs, weights(z, n), weights(bz, bn), idf)
    held = ready[cut:]
    if held:
        logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in held])
        truth = np.array([y for _, _, y in held])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = known.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
    lean = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    picked = Staging(spark).put(lean.join(F.broadcast(ids), "_id"))

    def featurize(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = [], []
        for text in batch.column(1).to_pylist():
            counts = gram_counts(text)
            hit = np.flatnonzero(counts)
            at.append(hit.astype(np.int32).tobytes())
            n.append(counts[hit].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary()), batch.column(2)], ["_id", "f", "n", "lang"])

    kind = picked.schema["_id"].dataType.simpleString()
    found = map_arrow(picked, featurize, f"_id {kind}, f binary, n binary, lang string").orderBy(F.xxhash64("_id"), "lang").limit(rows).collect()
    langs = sorted({r["lang"] for r in found})
    rows_in = [(np.frombuffer(r["f"], np.int32), np.frombuffer(r["n"], np.int32).astype(float), langs.index(r["lang"])) for r in found]
    return fit(rows_in, langs, 1 << FEATURE_BITS) if rows_in else Model([], np.zeros((1, 1)), np.zeros(1), np.zeros(1))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    small_batches(docs.sparkSession)
    lean = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages, a fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
        out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(lean, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
