"""Self-join of documents by Jaccard similarity of word shingles, with several global orders.

Equal shingle sets are one class, told apart by a 64-bit hash of the set. For similarity t and a set
of n shingles, two sets that link share a shingle among the first n - ceil(t n) + 1 of each under
any order of all shingles. Candidates must pass that test under three orders:

1. The first order ranks by how many classes hold a shingle, rare ones first, counted exactly for
   the shingles with the least hashes (a quarter of all at 0.9); the rest follow by hash, and are
   looked at only where a small set has too few of the former. Shingles of one class only never join.
   Shingles that have the same first and last holder and about as many holders share a bundle, so a
   class is sent to a bundle once and not once a shingle, and a pair is looked at in the least of
   the bundles it shares.
2. and 3. rank by two other hashes. The first shingles of the first order travel as 16-bit prints,
   those of the others are taken from the whole sets; a pair without a common one in each is ruled out.

Bundles are split into parts of at most BLOCK classes and WEIGHT shingles, and a task compares two
parts, so no group meets in one task. Pairs live inside the tasks only: the first pass filters them
(also by size, and by the parity bits of the sets, which bound their difference from below) and
names the classes that have a pair left; their whole sets are fetched once for each bundle, and the
second pass verifies the pairs and lets out a spanning tree of the links and a number of links for
each class. So what leaves a task grows with the classes that enter it. Links join classes to
components by label propagation. Where links need no count (`keep_one`), a task verifies the nearest
pairs first and then only those whose ends are not joined yet.

Rows are the documents. Null, empty and wordless texts are empty sets: they link with nothing and
are their own component. Fewer words than a shingle has make one shingle. Equal rows are copies of
each other. Ids may have any type with an order; rows without id are documents like others, and
their component is the least id in it, null if there is none. Texts of any length are read whole:
a long one weighs as many shingles as it has. Ties and other columns, whatever their names, have no
influence. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, components, map_arrow, mix, shingle_hashes, small_batches, texts_of, word_hashes

PARITY_BITS, KEPT, BLOCK, WEIGHT = 2048, 32, 1024, 2_000_000
#: Bound of the broadcast that picks the texts to verify: that many rows of 64 bits.
SLOT_WORDS = 1 << 20
#: Bound of the broadcast of large bundles; more of them are joined by a shuffle.
SENT_ROWS = 100_000
_ORDERS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
_GROUP = ["key", "low", "high"]
_ROW = "key long, low int, high int, own int, node long, n long, copies long, parity binary, shared array<smallint>, keys array<long>, n_keys int"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def region_end(percent: int) -> np.uint64:
    """Hashes below it are ranked by counts: a share of all that is larger than any prefix's."""
    return np.uint64(int((0.15 + 1 - percent / 100) * 2**64)) if percent > 15 else np.uint64(2**64 - 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def node_of(hashes: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        one, two = mix(hashes).sum(dtype=np.uint64), mix(hashes ^ _ORDERS[0]).sum(dtype=np.uint64)
        return int(mix(np.array([one ^ mix(np.array([two + np.uint64(len(hashes))]))[0]])).view(np.int64)[0])


def first_of(hashes: np.ndarray, percent: int, seed: np.uint64) -> np.ndarray:
    """Ranks of the first shingles of a set under the order of a seed."""
    ranked, p = mix(hashes ^ seed), prefix_length(len(hashes), percent)
    return np.partition(ranked, p - 1)[:p] if p < len(ranked) else ranked


def summary(hashes: np.ndarray, percent: int) -> tuple:
    """Name, region shingles, further shingles and parity bits of a sorted set of hashes."""
    n = len(hashes)
    p = prefix_length(n, percent)
    inside = hashes[hashes < region_end(percent)]
    outer = hashes[len(inside) : max(p, len(inside))]
    parity = np.packbits(np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1)
    return node_of(hashes), inside.view(np.int64), outer.view(np.int64), parity.tobytes()


def _summaries(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, rows = [], []
        for text in texts_of(batch.column(1)):
            hashes = np.unique(shingle_hashes(word_hashes(text or b""), k))
            n.append(len(hashes))
            rows.append(summary(hashes, percent) if len(hashes) else (None,) * 4)
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *cols], ["doc_id", "n", "node", "inside", "outer", "parity"])

    return map_arrow(lean, run, f"doc_id {kind}, n long, node long, inside array<long>, outer array<long>, parity binary")


def _bundled(reps: DataFrame, percent: int) -> DataFrame:
    """One row for each class and bundle of its first shingles that other classes hold."""
    inside = reps.select("node", F.lit(0).alias("part"), F.explode("inside").alias("shingle"))
    outer = reps.select("node", F.lit(1).alias("part"), F.explode("outer").alias("shingle"))
    each = inside.union(outer)
    counts = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("node").alias("first"), F.max("node").alias("last")).where("df > 1")
    counts = counts.select("shingle", "df", F.xxhash64("first", "last", F.floor(F.log2("df"))).alias("key"))
    some = F.struct("part", "df", "shingle", "key")
    ranked = each.join(counts, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(some)).alias("s"), F.count_if(F.col("part") == 0).cast("int").alias("held"))
    own = ranked.join(reps.select("node", "n", "copies", "parity", F.size("inside").alias("r")), "node")
    p = (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).cast("int")
    take = F.least(F.greatest(p - F.col("r") + F.col("held"), F.lit(0)), F.col("held"))  # region shingles come first
    own = own.withColumn("s", F.concat(F.slice("s", F.lit(1), take), F.slice("s", F.col("held") + 1, F.size("s"))))
    keys = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["key"])))
    shared = F.transform("s", lambda x: F.shiftright(F.shiftleft(x["shingle"], 48), 48).cast("smallint"))
    own = own.select("node", "n", "copies", "parity", shared.alias("shared"), keys.alias("all"))
    return own.select(F.explode("all").alias("key"), "node", "n", "copies", "parity", "shared", F.slice("all", 1, KEPT).alias("keys"), F.size("all").alias("n_keys"))


def _parts(bundled: DataFrame, block: int, staging: Staging) -> DataFrame:
    """Rows of bundles, once for each pair of parts their own part is in."""
    sizes = bundled.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    large = staging.put(sizes.select("key", parts.alias("parts")).where("parts > 1"))
    if large.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        large = F.broadcast(large)
    rows = bundled.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *_COLUMNS[4:])


class Lists:
    """Lists of small numbers, one for each row."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray, size: int):
        self.offsets, self.values, self.mark = offsets, values, np.zeros(size, dtype=bool)

    @classmethod
    def of(cls, found: list[np.ndarray]) -> Lists:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return cls.numbered(offsets, np.concatenate(found))

    @classmethod
    def numbered(cls, offsets: np.ndarray, values: np.ndarray) -> Lists:
        known, codes = np.unique(values, return_inverse=True)
        return cls(offsets, codes, len(known) + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values lists i and j of each pair have in common; lists hold a value once."""
        out = np.zeros(len(i), dtype=np.int64)
        starts = np.flatnonzero(np.concatenate([[len(i) > 0], i[1:] != i[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(i)], strict=False):
            mine = self.values[self.offsets[i[a]] : self.offsets[i[a] + 1]]
            self.mark[mine] = True
            for c in range(a, b, 256):
                to = j[c : min(c + 256, b)]
                sizes = self.offsets[to + 1] - self.offsets[to]
                ends = np.cumsum(sizes)
                at = np.repeat(self.offsets[to] - ends + sizes, sizes) + np.arange(ends[-1])
                hits = np.concatenate([[0], np.cumsum(self.mark[self.values[at]])])
                out[c : c + len(to)] = hits[ends] - hits[ends - sizes]
            self.mark[mine] = False
        return out


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def pairs_of(t: pa.Table, percent: int, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of the pairs within groups that pass all filters, bits they differ in, and
    whether another group may hold the pair too; sorted by i. The orders by hashes need the sets."""
    key, low, high, own, node, n = (t.column(c).to_numpy() for c in ("key", "low", "high", "own", "node", "n"))
    bits = np.frombuffer(b"".join(t.column("parity").to_pylist()), dtype=np.uint64).reshape(len(t), -1)
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    found, at, d = [], np.arange(len(t)), 0
    while True:
        d += 1
        at = at[at + d < len(t)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        i, j = at, at + d
        ok = (node[i] != node[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        ok &= (low[i] == high[i]) | (own[i] != own[j])
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = apart * (100 + percent) <= (100 - percent) * (n[i] + n[j])
        found.append(np.stack([i[ok], j[ok], apart[ok]]).astype(np.int32))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    i, j, apart = np.concatenate(found, axis=1)
    found.clear()
    by = np.lexsort((j, i))
    i, j, apart = i[by], j[by], apart[by]
    offsets, keys = _flat(t.column("keys"))
    rows = np.repeat(np.arange(len(t)), np.diff(offsets))
    before = keys < key[rows]
    earlier = Lists.numbered(np.concatenate([[0], np.cumsum(np.bincount(rows[before], minlength=len(t)))]), keys[before])
    known = (t.column("n_keys").to_numpy() <= KEPT) | (key <= keys[offsets[1:] - 1])
    ok = earlier.common(i, j) == 0
    i, j, apart = i[ok], j[ok], apart[ok]
    offsets, values = _flat(t.column("shared"))
    orders = [Lists(offsets, values.astype(np.int64) & 0xFFFF, 1 << 16)]
    if sets and len(i):
        orders += [Lists.of([first_of(x, percent, seed) for x in sets]) for seed in _ORDERS]
    for order in orders:
        ok = order.common(i, j) > 0
        i, j, apart = i[ok], j[ok], apart[ok]
    return i, j, apart, ~(known[i] & known[j])


def _grouped(rows: DataFrame, f: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over tables of whole groups of equal key, low and high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, dtype=bool)
            for c in _GROUP:
                col = batch.column(batch.schema.names.index(c)).to_numpy()
                same &= col == col[-1]
            cut = int(np.argmax(same))  # the last group starts here
            if held and (cut or any(held[-1][c][0].as_py() != batch[c][0].as_py() for c in _GROUP)):
                if cut:
                    held.append(batch.slice(0, cut))
                out = f(pa.Table.from_batches(held))
                if out is not None:
                    yield out
                held = [batch.slice(cut)]
            elif cut:
                out = f(pa.Table.from_batches([batch.slice(0, cut)]))
                if out is not None:
                    yield out
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held and (out := f(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, schema)


def _filtered(parts: DataFrame, percent: int) -> DataFrame:
    """Rows of the classes that have a pair left, in the groups where it is."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        i, j, _, _ = pairs_of(t, percent)
        rows = np.unique(np.concatenate([i, j]))
        return t.take(pa.array(rows)).combine_chunks().to_batches()[0] if len(rows) else None

    return _grouped(parts.select(*_COLUMNS), run, _ROW)


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set binary) of the wanted classes.

    Texts are picked by hash values of ids, kept as bits in at most SLOT_WORDS rows and so safe to
    broadcast, rather than by a join that would move all texts; a text picked by chance is of no
    wanted class and drops out of the join.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(64 * SLOT_WORDS))
    word, bit = F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")
    bits = wanted.select(F.col("rep").alias("id")).select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text", word, bit)
    lean = lean.join(F.broadcast(bits), "word").where("getbit(bits, bit) = 1").select("id", "text")
    kind = lean.schema["id"].dataType.simpleString()

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(word_hashes(t or b""), k)) for t in texts_of(batch.column(1))]
        nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "node", "set"])

    found = map_arrow(lean, whole, f"id {kind}, node long, set binary").alias("f")
    rep = wanted.select(F.col("node").alias("of"), "rep")
    found = found.join(rep, (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep")))
    return found.groupBy("node").agg(F.first("set").alias("set"))


def _trees(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is joined with."""
    label = np.arange(size)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _linked(rows: DataFrame, percent: int, count: bool) -> DataFrame:
    """(a, b, w): edges of spanning trees without w; numbers of links w of a class a, without b;
    and with both, links that other groups may tell again."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        found = [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").to_pylist()]
        i, j, apart, again = pairs_of(t, percent, found)
        if not len(i):
            return None
        node, n, copies = (t.column(c).to_numpy() for c in ("node", "n", "copies"))
        sets = Lists.of(found)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = sets.common(i, j)
            return 100 * both >= percent * (n[i] + n[j] - both)

        if count:
            ok = linked(i, j)
            i, j, again = i[ok], j[ok], again[ok]
            label = _trees(len(t), i, j)
        else:
            keep_i, keep_j = [], []
            label = np.arange(len(t))
            for tries in (1, 2, 4, None):  # nearest pairs first, then only across trees
                if not len(i):
                    break
                by = np.lexsort((apart, i))
                i, j, apart = i[by], j[by], apart[by]
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                rank = np.arange(len(i)) - np.repeat(starts, np.diff([*starts, len(i)]))
                now = rank < (tries or len(i))
                ok = linked(i[now], j[now])
                keep_i.append(i[now][ok])
                keep_j.append(j[now][ok])
                label = _trees(len(t), np.concatenate(keep_i), np.concatenate(keep_j))
                left = ~now & (label[i] != label[j])
                i, j, apart = i[left], j[left], apart[left]
        child = np.flatnonzero(label != np.arange(len(t)))
        a, b, w = [node[label[child]]], [pa.array(node[child])], [pa.nulls(len(child), pa.int64())]
        if count:
            sure = ~again
            for x, y in ((i, j), (j, i)):
                sums = np.bincount(x[sure], weights=copies[y[sure]], minlength=len(t)).astype(np.int64)
                some = np.flatnonzero(sums)
                a += [node[some], node[x[~sure]]]
                b += [pa.nulls(len(some), pa.int64()), pa.array(node[y[~sure]])]
                w += [pa.array(sums[some]), pa.array(copies[y[~sure]])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.concat_arrays(b), pa.concat_arrays(w)], ["a", "b", "w"])

    return _grouped(rows.select(*_COLUMNS, "set"), run, "a long, b long, w long")


def join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) for each document.

    n_links counts the other documents it links with, copies among them; it is left out, and with
    it the verification of pairs that are joined anyway, unless count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    all_ = staging.put(_summaries(docs, k, percent, id_col, text_col))
    lean = staging.put(all_.select("doc_id", "n", "node"))
    same = [F.first(c).alias(c) for c in ("n", "inside", "outer", "parity")]
    reps = staging.put(all_.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *same))
    staging.drop(1)
    bundled = staging.put(_bundled(reps, percent))
    classes = staging.put(reps.select("node", "rep", "copies"))
    staging.drop(3)
    left = staging.put(_filtered(_parts(bundled, block, staging), percent))
    staging.drop(4)
    wanted = staging.put(left.select("node").distinct().join(classes.select("node", "rep"), "node"))
    sets = _sets(docs, wanted, k, id_col, text_col)
    links = staging.put(_linked(left.join(sets, "node"), percent, count))
    staging.drop(7)
    roots = components(spark, links.where("b is not null").select("a", "b"), staging)
    known = classes.join(roots, classes.node == roots.node, "left").select(classes.node, "rep", "copies", "root")
    least = known.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    known = known.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")))
    shown = ["component_id", F.col("rep").alias("class_id")]
    if count:
        sure = links.where("b is null").select("a", "w").union(links.where("b is not null and w is not null").distinct().select("a", "w"))
        known = known.join(sure.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("near")), "node", "left")
        shown.append((F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    full = lean.where("n > 0").join(known.select("node", *shown), "node").drop("node").withColumnRenamed("n", "n_shingles")
    own = F.col("doc_id")
    none = lean.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.alias("class_id"))
    return full.unionByName(none.withColumn("n_links", F.lit(0).cast("long")) if count else none)


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the least id of each component; columns stay, and so do rows without id."""
    found = join(docs, k, percent, id_col, text_col, count=False)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
