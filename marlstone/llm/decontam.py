"""Benchmark decontamination with SimHash of item-sized windows.

Words are compared in lower case and without ASCII punctuation. A benchmark item is the weighted set
of its 5-word shingles (of one shingle where it has fewer words); weights are inverse document
frequencies over all items. Windows of as many shingles as the item has slide over the whole
document, and a shorter document is one window.

1. One pass over the documents keeps runs of shingles: around each shingle that some item holds, as
   far as the longest window reaches. Windows without any have similarity 0. The test is a table of
   bits, fixed in size, so that a false hit costs time and never a result.
2. Each window of a run gets a 64-bit SimHash. All items of its size are looked up by a multi-index:
   BLOCKS blocks of bits, in one of which at least any two fingerprints within RADIUS bits differ by
   no more than RADIUS // BLOCKS bits, so tables of all values that near to an item's tell which
   windows may have a partner. All fingerprints within the radius are found; which item it is comes
   from the fingerprints alone.
3. Pairs within the radius are verified by exact weighted Jaccard similarity of the shingle sets.

At similarity 0.8 the expected distance is about 10 bits with a deviation of 3, so RADIUS 15 finds
about 97 in 100 windows, and better aligned or nearer ones more surely (tests measure the recall).

The items are the stated query set: their fingerprints are broadcast in blocks of ITEM_BLOCK, each of
which is compared with the runs, not with the documents. Null or empty texts, and items without
words, match nothing. Repeated rows are each reported; ties between windows go to the first one.
An empty table on either side gives no rows. Long texts become several runs. Other columns, whatever
their names, have no influence; ids may have any type and may be null.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, map_arrow, shingle_hashes, small_batches, texts_of, word_hashes

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
#: Items whose fingerprints (8 bytes each) are broadcast at once.
ITEM_BLOCK = 1 << 20
#: Words of 64 bits in the table of known shingles: bounds its broadcast to 16 MB.
GATE_WORDS = 1 << 21
#: Windows in one run.
RUN = 4096
_MARKS = string.punctuation.encode()
_BITS = np.arange(64, dtype=np.uint64)
_WIDTH = 64 // BLOCKS


def normal_words(text: bytes) -> np.ndarray:
    """Hashes of words in lower case of any script, without ASCII punctuation."""
    return word_hashes(text.decode().lower().encode().translate(None, _MARKS))


def fingerprints(hashes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of `size` shingles."""
    signs = ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.float32) * 2 - 1
    sums = np.zeros((len(hashes) + 1, 64))
    np.cumsum(signs * weights[:, None], axis=0, out=sums[1:])
    bits = (sums[size:] - sums[:-size]) > 1e-9
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def block_of(prints: np.ndarray, k: int) -> np.ndarray:
    return ((prints >> np.uint64(k * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)


@lru_cache(maxsize=4)
def _near(radius: int) -> np.ndarray:
    """Values of a block with at most that many bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(_WIDTH), n)], dtype=np.int64)


class Prints:
    """Multi-index of the fingerprints of items of one size."""

    def __init__(self, nos: np.ndarray, prints: np.ndarray, radius: int = RADIUS):
        self.nos, self.prints, self.radius = nos, prints, radius
        self.tables = np.zeros((BLOCKS, 1 << _WIDTH), dtype=bool)
        for k in range(BLOCKS):
            values = np.unique(block_of(prints, k))
            for near in _near(radius // BLOCKS).tolist():
                self.tables[k, values ^ near] = True

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item number, distance) of all pairs within the radius."""
        some = np.zeros(len(prints), dtype=bool)
        for k in range(BLOCKS):
            some |= self.tables[k, block_of(prints, k)]
        at = np.flatnonzero(some)
        step = max(1, 2_000_000 // len(self.prints))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            distance = np.bitwise_count(prints[part][:, None] ^ self.prints)
            for i, no in zip(*np.nonzero(distance <= self.radius), strict=True):
                yield int(part[i]), int(self.nos[no]), int(distance[i, no])


def _shingled(text: bytes) -> tuple[int, np.ndarray]:
    words = normal_words(text)
    width = min(SHINGLE, len(words))
    return width, shingle_hashes(words, width) if width else words


def _items(items: DataFrame, item_col: str, text_col: str, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """Items (no, item_id, width, size, hashes, weights, total), and the shingles' (hash, weight)."""
    lean = items.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_shingled(t or b"") for t in texts_of(batch.column(2))]
        cols = [pa.array([w for w, _ in found], pa.int32()), pa.array([len(h) for _, h in found], pa.int32()), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["no", "item_id", "width", "size", "hashes"])

    kind = lean.schema["item_id"].dataType.simpleString()
    rows = staging.put(map_arrow(lean, run, f"no long, item_id {kind}, width int, size int, hashes array<long>").where("size > 0"))
    many = rows.count()
    each = rows.select("no", F.posexplode("hashes").alias("at", "hash"))
    known = each.select("no", "hash").distinct().groupBy("hash").agg(F.log1p(F.lit(float(many)) / F.count("*")).alias("weight"))
    known = staging.put(known)
    told = each.join(known, "hash").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("w"))
    told = told.select("no", F.transform("w", lambda x: x["weight"]).alias("weights"))
    return staging.put(rows.join(told, "no").withColumn("other", F.lit(float(np.log1p(many))))), known


def _gate(known: DataFrame) -> np.ndarray:
    """Two bits for each known shingle, in at most GATE_WORDS words, some 256 bits for each."""
    words = 1 << min(GATE_WORDS.bit_length() - 1, max(10, (4 * known.count()).bit_length()))
    slots = F.array(F.pmod("hash", F.lit(64 * words)), F.pmod(F.shiftrightunsigned("hash", 32), F.lit(64 * words)))
    bits = known.select(F.explode(slots).alias("s")).select(F.shiftright("s", 6).alias("word"), F.col("s").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    gate = np.zeros(words, dtype=np.int64)
    for r in bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toLocalIterator():
        gate[r["word"]] = r["bits"]
    return gate.view(np.uint64)


def _passes(gate: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the table knows; a few others pass by chance."""
    ok = np.ones(len(hashes), dtype=bool)
    for slot in (hashes & np.uint64(64 * len(gate) - 1), (hashes >> np.uint64(32)) & np.uint64(64 * len(gate) - 1)):
        ok &= ((gate[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def _runs(docs: DataFrame, gate: np.ndarray, longest: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, mark, width, start, hashes, hits): runs around the places of known shingles."""
    text = F.col(text_col)
    lean = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    lean = lean.where(F.col("text").isNotNull())
    kind = lean.schema["doc_id"].dataType.simpleString()
    bits = docs.sparkSession.sparkContext.broadcast(gate)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for i, t in enumerate(texts_of(batch.column(3))):
            words = normal_words(t)
            for width, size in longest.items():
                if len(words) < width:
                    continue
                hashes = shingle_hashes(words, width)
                hits = np.flatnonzero(_passes(bits.value, hashes))
                if not len(hits):
                    continue
                last = max(len(hashes) - size, 0)  # of the starts of windows
                cover = np.zeros(last + 2, dtype=np.int64)
                np.add.at(cover, np.maximum(hits - size + 1, 0).clip(max=last), 1)
                np.add.at(cover, np.minimum(hits, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover)[: last + 1] > 0)
                for piece in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for a in range(int(piece[0]), int(piece[-1]) + 1, RUN):
                        end = min(a + RUN, int(piece[-1]) + 1) + size - 1
                        own = hits[np.searchsorted(hits, a) : np.searchsorted(hits, end)]
                        out.append((i, width, a, len(hashes), hashes[a:end].view(np.int64), own - a))
        if not out:
            return None
        at, width, start, n, hashes, hits = zip(*out, strict=True)
        own = [batch.column(k).take(pa.array(at)) for k in range(3)]
        long = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [*own, pa.array(width, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, long), pa.array(hits, long)],
            ["row", "doc_id", "mark", "width", "start", "n", "hashes", "hits"],
        )

    return map_arrow(lean, run, f"row long, doc_id {kind}, mark long, width int, start long, n long, hashes array<long>, hits array<long>")


def _weighed(runs: DataFrame, known: DataFrame) -> DataFrame:
    """runs whose hits are the places of known shingles, with their weights."""
    key = ["row", "width", "start"]
    each = runs.select(*key, F.explode(F.expr("transform(hits, p -> struct(p AS at, hashes[p] AS hash))")).alias("x")).select(*key, "x.*")
    told = each.join(known, "hash").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("w"))
    told = told.select(*key, F.transform("w", lambda x: x["at"]).alias("hits"), F.transform("w", lambda x: x["weight"]).alias("weights"))
    return runs.drop("hits").join(told, key)


def _pairs(runs: DataFrame, prints: list[tuple], other: float) -> DataFrame:
    """(row, width, start, place, size, no, distance) of windows and items within the radius."""
    groups: dict[tuple[int, int], list] = {}
    for no, width, size, value in prints:
        groups.setdefault((width, size), []).append((no, value))
    found = {k: (np.array([no for no, _ in v]), np.array([x for _, x in v], dtype=np.int64).view(np.uint64)) for k, v in groups.items()}
    sent = runs.sparkSession.sparkContext.broadcast(found)
    index: dict[tuple[int, int], Prints] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for i, r in enumerate(batch.select(["width", "start", "n", "hashes", "hits", "weights"]).to_pylist()):
            hashes = np.array(r["hashes"], dtype=np.int64).view(np.uint64)
            weights = np.full(len(hashes), other)
            weights[r["hits"]] = r["weights"]
            at = np.zeros(len(hashes) + 1, dtype=np.int64)
            at[1:][r["hits"]] = 1
            at = np.cumsum(at)
            for key, (nos, values) in sent.value.items():
                size = min(key[1], r["n"])
                if key[0] != r["width"] or size > len(hashes):
                    continue
                if key not in index:
                    if len(index) >= 256:
                        index.clear()
                    index[key] = Prints(nos, values)
                places = np.flatnonzero(at[size:] > at[:-size])
                if len(places):
                    windows = fingerprints(hashes, weights, size)[places]
                    out += [(i, int(places[p]), size, no, d) for p, no, d in index[key].within(windows)]
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        own = [batch.column(batch.schema.names.index(c)).take(pa.array(cols[0])) for c in ("row", "width", "start")]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in cols[1:])], ["row", "width", "start", "place", "size", "no", "distance"])

    return map_arrow(runs, run, "row long, width int, start long, place long, size long, no long, distance long")


def _verified(pairs: DataFrame, runs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """The best window of each row and item whose similarity is high enough."""
    key = ["row", "width", "start"]
    grouped = pairs.groupBy(*key, "no").agg(F.collect_list(F.struct("place", "size", "distance")).alias("windows"))
    both = grouped.join(runs.select(*key, "doc_id", "mark", "hashes", "hits", "weights"), key)
    both = both.join(items.select("no", "item_id", F.col("hashes").alias("of"), F.col("weights").alias("of_weights"), "other"), "no")
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("doc_id", "item_id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for i, r in enumerate(batch.select(["windows", "hashes", "hits", "weights", "of", "of_weights", "other", "start"]).to_pylist()):
            mine = dict(zip(r["of"], r["of_weights"], strict=True))
            known = dict(zip((r["hashes"][p] for p in r["hits"]), r["weights"], strict=True))
            total, best = sum(mine.values()), None
            for w in sorted(r["windows"], key=lambda w: w["place"]):
                inside = union = 0.0
                for h in set(r["hashes"][w["place"] : w["place"] + w["size"]]):
                    if h in mine:
                        inside += mine[h]
                    else:
                        union += known.get(h, r["other"])
                s = min(inside / (union + total), 1.0)
                if s >= similarity and (best is None or s > best[1]):
                    best = (i, s, r["start"] + w["place"], w["distance"])
            if best:
                out.append(best)
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        own = [batch.column(batch.schema.names.index(c)).take(pa.array(cols[0])) for c in ("row", "mark", "doc_id", "item_id", "no")]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in cols[1:])], ["row", "mark", "doc_id", "item_id", "no", "similarity", "first_word", "distance"])

    found = map_arrow(both, run, f"row long, mark long, {kinds}, no long, similarity double, first_word long, distance long")
    best = F.min_by(F.struct("doc_id", "mark", "item_id", "similarity", "first_word", "distance"), F.struct(-F.col("similarity"), "first_word")).alias("b")
    return found.groupBy("row", "no").agg(best).select("b.*")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, mark, item_id, similarity, first_word, distance); mark is a hash of the document's text."""
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    bench, known = _items(items, item_col, item_text, staging)
    longest = {r["width"]: r["size"] for r in bench.groupBy("width").agg(F.max("size").alias("size")).collect()}
    runs = staging.put(_runs(docs, _gate(known), longest, id_col, text_col))
    runs = staging.put(_weighed(runs, known))
    many = bench.count()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprints(np.array(h, dtype=np.int64).view(np.uint64), np.array(w), len(h))[0] for h, w in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(values, dtype=np.uint64).view(np.int64))], ["no", "width", "size", "print"])

    prints = staging.put(map_arrow(bench.select("no", "width", "size", "hashes", "weights"), one, "no long, width int, size int, print long"))
    blocks = max(1, -(-many // block))
    pairs = None
    for k in range(blocks):
        rows = [tuple(r) for r in prints.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == k).orderBy("no").toLocalIterator()]
        found = _pairs(runs, rows, float(np.log1p(many)))
        pairs = found if pairs is None else pairs.union(found)
    return _verified(staging.put(pairs), runs, bench, similarity)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, distance) for each document and item found in it."""
    return matches(docs, items, id_col, text_col, item_col, similarity=similarity, block=block).drop("mark")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without those that hold an item; other rows and columns stay."""
    gone = matches(docs, items, id_col, text_col, item_col, item_text).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(text_col)) == F.col("_mark")), "left_anti")
