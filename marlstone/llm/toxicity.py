"""Toxicity from maximum-scoring segments of token log-odds.

Training: on a bounded sample of labelled documents (TRAIN_ROWS, least hashes of the id first),
each text once and groups of near copies (equal least shingle) once, the documents that hold a token are counted by label. The log-odds of a
token have an informative Dirichlet prior: pseudo-documents, PRIOR times as many as there are, spread
like the whole sample.
Tokens that OFTEN documents of the sample hold stand for themselves. Rarer ones are counted by their
beginnings (LEAST_STEM to MOST_STEM characters) as well, so that inflected and compound forms count by
their stem: such a token has the log-odds of the beginning whose z-score is largest, else its own.
What has a small z-score counts as neutral, at any mix of labels; every token also pays DRIFT, so that
the mean over clean text is negative. The driver holds the tokens and stems that count or are frequent,
as many as the bounded sample has at most.

Scoring: a linear scan finds all maximal scoring segments of the whole text. A segment of score S in
a text of n tokens is significant by extreme-value statistics, with lambda the root of
E[exp(lambda s)] = 1 over clean tokens and K fitted to the maxima of clean documents. The sum of
the significant segments' excess, lambda S - ln(K n), is turned into a chance by logistic
regression on the sample.

A null or empty text has no segment and gets the chance of that. With no labels, or labels of one
kind, every score is the smoothed base rate. Several labels of an id count as toxic if one is.
Repeated rows are scored alike; other columns are not read. Texts of any length are scanned whole. An
empty table gives no rows; rows without id are scored, and are never among the held-out ones.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, map_arrow, shingle_hashes, small_batches, texts_of, word_hashes

#: Bound of the fit: labelled rows.
TRAIN_ROWS = 16_000
OFTEN, LEAST_STEM, MOST_STEM = 30, 3, 8
#: Bound of the table of scored tokens of a task.
KEPT = 300_000
PRIOR, DRIFT, LEAST_Z, THRESHOLD, FOLDS = 0.3, 0.25, 3.5, 0.3, 4
_EDGES = string.punctuation.encode()


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased and punctuation stripped from their ends."""
    return [w.strip(_EDGES) for w in text.lower().split()]


def stems(word: bytes) -> list[bytes]:
    """Beginnings of a token, marked by an asterisk, which no token ends with."""
    text = word.decode()
    return [text[:k].encode() + b"*" for k in range(LEAST_STEM, min(len(text) - 1, MOST_STEM) + 1)]


def maximal_segments(scores: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of scored runs (score, start, end), in linear time.

    Candidates are kept with the sum before them (low) and up to them (high). A new positive run
    looks back for the last candidate with a lower sum before it; if that has a lower sum up to it
    as well, everything from there on merges, and the search goes on from the merged candidate.
    """
    kept: list[list] = []  # low, high, start, end, index of the last candidate with a lower low
    total = 0.0
    for score, start, end in scores:
        if score <= 0:
            total += score
            continue
        low, high = total, total + score
        total = high
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= high:
                kept.append([low, high, start, end, j])
                break
            low, start = kept[j][0], kept[j][2]
            del kept[j:]
    return [(k[1] - k[0], k[2], k[3]) for k in kept]


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    stems: dict[bytes, tuple[float, float]] = field(default_factory=dict)  # score and z
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    bias: float = -3.0
    often: set[bytes] = field(default_factory=set)
    known: dict[bytes, float | None] = field(default_factory=dict, repr=False)

    def score_of(self, word: bytes) -> float | None:
        if word not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = [x for f in stems(word) if (x := self.stems.get(f))] if word not in self.often else None
            self.known[word] = max(found, key=lambda x: x[1])[0] if found else self.scores.get(word)
        return self.known[word]

    def segments(self, text: bytes) -> tuple[list[tuple[float, int, int]], int]:
        """Maximal segments (score, first token, end) and the number of tokens."""
        words = tokens(text)
        marked = [(i, s) for i, s in enumerate(map(self.score_of, words)) if s is not None] if self.scores or self.stems else []
        runs, at = [], 0
        for i, s in marked:
            if i > at:
                runs.append((-DRIFT * (i - at), at, i))
            runs.append((s, i, i + 1))
            at = i + 1
        return maximal_segments(runs), len(words)

    def significant(self, text: bytes) -> tuple[list[tuple[float, int, int]], float]:
        """Segments whose excess is positive, as (excess, first token, end), and their sum."""
        found, n = self.segments(text)
        floor = self.log_k + np.log(max(n, 1))
        out = [(self.lam * s - floor, a, b) for s, a, b in found if self.lam * s > floor]
        return out, float(sum(x[0] for x in out))

    def score(self, excess: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(excess))))


def _fit_lambda(scores: dict[bytes, float], clean: dict[bytes, int], total: int) -> float:
    """Root of E[exp(lambda s)] = 1 over the tokens of clean documents."""
    s = np.array([*scores.values(), -DRIFT])
    p = np.array([*(clean.get(w, 0) for w in scores), 0], dtype=float)
    p[-1] = max(total - p.sum(), 1)
    p /= p.sum()
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 50))).sum() < 1 else (low, mid)
    return (low + high) / 2


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of logistic regression by Newton steps with a light ridge."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.array([0.0, np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2, 0.0]) * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, staging: Staging, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents outside the held-out part, staged.

    Only the ids of the sample, at most `rows`, are broadcast.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    lean = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return staging.put(lean.join(F.broadcast(known), "_id").select("text", "y"))


def _weigh(counts: DataFrame, often: set[bytes]) -> Model | None:
    """Token scores and lambda from (w, clean, toxic); None unless both labels occur."""
    counts = counts.groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    docs_n = counts.where(F.length("w") == 0).select("clean", "toxic").first()
    if docs_n is None or not docs_n[0] or not docs_n[1]:
        return None
    n0, n1 = docs_n
    whole = PRIOR * (n0 + n1)
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + whole - F.col(y) - prior))
    words = counts.where((F.length("w") > 0) & (F.col("clean") + F.col("toxic") >= 3)).select(
        "w", "clean", (odds("toxic", n1) - odds("clean", n0)).alias("d"), F.sqrt(1 / (F.col("clean") + prior) + 1 / (F.col("toxic") + prior)).alias("sd")
    )
    z = F.abs(F.col("d") / F.col("sd"))
    # no least odds: the prior caps the odds of a rare token, and that cap falls as more labels are toxic
    best = words.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy("w").collect()
    total = counts.where((F.length("w") > 0) & (F.col("w").substr(-1, 1) != F.lit(b"*"))).agg(F.sum("clean")).first()[0] or 1
    found = {bytes(r["w"]): r["d"] - DRIFT for r in best}
    z = {bytes(r["w"]): r["z"] for r in best}
    model = Model({w: s for w, s in found.items() if w[-1:] != b"*"}, {w: (s, z[w]) for w, s in found.items() if w[-1:] == b"*"}, often=often)
    model.lam = _fit_lambda(found, {bytes(r["w"]): r["clean"] for r in best}, total)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Scores from the whole sample; statistics and chances from folds that score each other."""
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    rated = sample(docs, labels, staging, id_col, text_col, label_col, rows)

    def least_shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles = [shingle_hashes(word_hashes(t), 5) for t in texts_of(batch.column(0))]
        key = [int(x.min().view(np.int64)) if len(x) else None for x in shingles]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.int64())], ["text", "y", "key"])

    # copies and most near copies share their least shingle: a group of them counts as one document
    keyed = map_arrow(rated, least_shingle, "text string, y double, key long")
    once = keyed.groupBy("key").agg(F.min("text").alias("text"), (F.avg("y") >= 0.5).cast("double").alias("y")).drop("key")
    once = staging.put(once.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))

    def counted(of: Callable[[set[bytes]], set[bytes]]) -> DataFrame:
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict[tuple[bytes, int], list[int]] = {}
            for text, y, fold in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for w in of(set(tokens(text))):
                    seen.setdefault((w, fold), [0, 0])[int(y)] += 1
            cols = [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32())]
            cols += [pa.array([v[y] for v in seen.values()], pa.int64()) for y in (0, 1)]
            return pa.RecordBatch.from_arrays(cols, ["w", "fold", "clean", "toxic"])

        each = map_arrow(once, count, "w binary, fold int, clean long, toxic long")
        return staging.put(each.groupBy("w", "fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))

    counts = counted(lambda words: words | {b""})  # the empty one counts documents
    frequent = counts.groupBy("w").agg(F.sum(F.col("clean") + F.col("toxic")).alias("n")).where(f"n >= {OFTEN}")
    often = {bytes(r["w"]) for r in frequent.select("w").collect()}
    counts = counts.union(counted(lambda words: {f for w in words - often for f in stems(w)}))
    model = _weigh(counts, often)
    if model is None:
        n = {r[0]: r[1] for r in rated.groupBy("y").count().collect()}
        clean, toxic = n.get(0.0, 0), n.get(1.0, 0)
        return Model(bias=float(np.log((toxic + 0.5) / (clean + (8.5 if not n else 0.5)))))
    folds = [_weigh(counts.where(F.col("fold") != h), often) or model for h in range(FOLDS)]

    def tops(batch: pa.RecordBatch) -> pa.RecordBatch:
        top, n = [], []
        for text, fold in zip(texts_of(batch.column(0)), batch.column(2).to_pylist(), strict=True):
            found, size = folds[fold].segments(text)
            top.append(folds[fold].lam * max((s for s, _, _ in found), default=0.0))
            n.append(size)
        return pa.RecordBatch.from_arrays([pa.array(top), pa.array(n, pa.int64()), batch.column(1), batch.column(2)], ["top", "n", "y", "fold"])

    maxima = map_arrow(once, tops, "top double, n long, y double, fold int").where("y = 0 and n > 0")
    # an extreme-value law has mean (ln K n + 0.5772) / lambda
    mean = {r[0]: r[1] for r in maxima.groupBy("fold").agg(F.avg(F.col("top") - F.log("n"))).collect()}
    for h, m in enumerate(folds):
        m.log_k = float(max(mean.get(h, 0.0) - 0.5772, -8.0))
    model.log_k = float(np.mean([m.log_k for m in folds]))

    def excesses(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [folds[h].significant(t)[1] for t, h in zip(texts_of(batch.column(0)), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x), batch.column(1)], ["x", "y"])

    found = map_arrow(once, excesses, "x double, y double").collect()  # at most `rows` pairs
    x, y = np.log1p(np.array([r[0] for r in found])), np.array([r[1] for r in found])
    model.slope, model.bias = _fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages): spans count tokens."""
    small_batches(docs.sparkSession)
    lean = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.significant(t or b"") for t in texts_of(batch.column(2))]
        chance = model.score(np.array([f[1] for f in found]))
        spans = [",".join(f"{a}:{b}" for _, a, b in f[0]) for f in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32)), pa.array([len(f[0]) for f in found], pa.int32()), pa.array(spans, pa.string())],
            ["doc_id", "held_out", "score", "predicted", "n_passages", "passages"],
        )

    return map_arrow(lean, run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages int, passages string")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those predicted toxic; rows and columns are passed through one Python stage."""
    model = train(docs, labels, id_col, text_col)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        excess = np.array([model.significant(t or b"")[1] for t in texts_of(batch.column(at))])
        return batch.filter(pa.array(model.score(excess) < THRESHOLD))

    return map_arrow(docs, run, docs.schema)
