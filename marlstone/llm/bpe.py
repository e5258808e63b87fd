"""BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash over the bytes of a text marks chunk borders, anywhere between two characters.
   Chunks are named by a 128-bit hash and counted over all texts.
2. A chunk that occurs again is encoded once, by the first text that holds it, and its ids are
   published in a table; the other texts get them by a join on the name. Only texts with such chunks
   are moved; the rest are encoded where they are read. Which texts are moved is told by a table of
   bits, fixed in size: a text moved by chance finds no published chunk and is encoded as a whole.
3. Joins are repaired: what stands between the last white space before a border and the first one
   after it is encoded again as a whole and replaces the ids of both fragments unless it agrees with
   them; a chunk without white space passes the fragment on to the next border.

No token spans white space and decoding joins tokens by blanks: `seam_free` checks both for a
tokenizer before chunks are used; without it each text is given to the library whole. Under the same
check the ids of a run of characters without white space are kept in a bounded table of the task.

A null or empty text has no tokens. Equal rows are each encoded; a chunk twice in one text is shared
like one in two texts. Texts of any length are read whole; ids of documents may be null or repeated.
An empty table gives no rows. Nothing depends on other columns.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Staging, map_arrow, small_batches, texts_of

VOCABULARY = "word_bpe_49k.json"
#: Bytes of the rolling window, mean chunk as a power of two, least chunk, bound of the table of a task.
WINDOW, MEAN_BITS, LEAST, KEPT_PIECES = 16, 9, 128, 300_000
#: Rows of 64 bits that tell which texts are moved: bounds the broadcast.
MARK_WORDS = 1 << 20
SPACE = b" \t\n\r\x0b\x0c"
_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint64)
_TAIL = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|\Z)")
_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_SEGMENT = "at int, name binary, shared boolean, ids binary, head binary, tail binary, n_head int, n_tail int, bare boolean"


def borders(text: bytes) -> list[int]:
    """Ends of chunks: where the rolling hash of the last WINDOW bytes has MEAN_BITS zero bits,
    moved on to the next character, and LEAST bytes or more after the last one."""
    n = len(text)
    if n <= WINDOW:
        return [n] if n else []
    codes = np.frombuffer(text, dtype=np.uint8)
    sums = np.cumsum(_GEAR[codes], dtype=np.uint64)
    rolled = sums[WINDOW:] - sums[:-WINDOW]
    rolled = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEAN_BITS)
    out, last = [], 0
    for at in (np.flatnonzero(rolled == 0) + WINDOW + 1).tolist():
        while at < n and text[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= LEAST and at < n:
            out.append(at)
            last = at
    return [*out, n]


def chunks(text: bytes) -> list[bytes]:
    ends = borders(text)
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class Coder:
    """Encoder and decoder of one task. Ids are packed in four bytes each."""

    def __init__(self, path: str, tokenizer=None):
        if tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.tokenizer = tokenizer
        self.names = [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size())]
        self.pieces: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.joins = self.repairs = 0
        self.by_piece = self.seam_free()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def seam_free(self) -> bool:
        """Whether white space ends tokens, a comma or stop after a letter is a token of its own,
        A-Z count as a-z, and decoding joins tokens by blanks."""
        probe = "it's Oné <|endoftext|>x É中1 22!?, 'llİ don't Word, END. a.b,"
        parts = probe.split(" ")
        whole, each = self._ids([probe])[0], self._ids(parts)
        if [i for x in each for i in x] != whole or self._ids(["Word, END. a's,"]) != self._ids(["word , end . a's ,"]):
            return False
        return " ".join(self.tokenizer.id_to_token(i) for i in whole) == self.tokenizer.decode(whole, skip_special_tokens=False)

    def _words(self, text: bytes) -> list[bytes]:
        """Runs without white space; a comma or stop that ends a word stands alone."""
        if b"<|" in text:  # may hold a special token, whose case counts
            return text.split()
        return _TAIL.sub(rb" \1", text.lower()).split()

    def encode(self, text: bytes) -> bytes:
        if not self.by_piece:
            return np.array(self._ids([text.decode()])[0], dtype=np.uint32).tobytes()
        words, table = self._words(text), self.pieces
        fresh = [w for w in set(words) if w not in table]
        if fresh:
            if len(table) > KEPT_PIECES:  # the older half goes unless it is used again
                self.before, self.pieces = table, {}
                table, fresh = self.pieces, list(set(words))
            if before := self.before:
                table.update({w: before[w] for w in fresh if w in before})
                fresh = [w for w in fresh if w not in table]
            for w, ids in zip(fresh, self._ids([w.decode() for w in fresh]), strict=True):
                table[w] = np.array(ids, dtype=np.uint32).tobytes()
        return b"".join([table[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, dtype=np.uint32).tolist()
        if not self.by_piece:
            return self.tokenizer.decode(found, skip_special_tokens=False).encode() if found else b""
        names = self.names
        return b" ".join([names[i] for i in found])

    def segment(self, text: bytes) -> tuple[bytes, bytes, bytes, int, int, bool]:
        """Ids of a part of a text, its fragments at either end and how many ids they have, and
        whether it is a single fragment."""
        white = _WHITE.search(text)
        head = text[: white.start()] if white else text
        tail = b"" if not white or text[-1] in SPACE else text.rsplit(None, 1)[-1]
        middle = text[len(head) : len(text) - len(tail)]
        parts = [self.encode(x) if x else b"" for x in (head, middle, tail)]
        return b"".join(parts), head, tail, len(parts[0]) // 4, len(parts[2]) // 4, white is None

    def join(self, segments: list[tuple[bytes, bytes, bytes, int, int, bool]]) -> bytes:
        """Ids of the text whose parts these are."""
        out, tail, n_tail = bytearray(), b"", 0
        for ids, head, last, n_head, n_last, bare in segments:
            if tail and head:
                self.joins += 1
                both = self.encode(tail + head)
                if out[len(out) - 4 * n_tail :] + ids[: 4 * n_head] != both:
                    self.repairs += 1
                out[len(out) - 4 * n_tail :] = both
                out += ids[4 * n_head :]
                n_head = len(both) // 4
            else:
                out += ids
                n_head += n_tail if bare else 0
            tail, n_tail = (tail + head, n_head) if bare else (last, n_last)
        return bytes(out)


@lru_cache(maxsize=2)
def coder_of(vocabulary: str) -> Coder:
    return Coder(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded binary): ids as little-endian unsigned 32-bit integers."""
    return _encoded(docs, vocabulary, id_col, text_col, digest=False)


def digest(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return _encoded(docs, vocabulary, id_col, text_col, digest=True)


def _named(lean: DataFrame, vocabulary: str) -> DataFrame:
    """(key, at, name) of each chunk."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not coder_of(vocabulary).by_piece:
            return None
        rows, at, names = [], [], []
        for i, t in enumerate(texts_of(batch.column(1))):
            for k, c in enumerate(chunks(t or b"")):
                rows.append(i)
                at.append(k)
                names.append(xxh3_128_digest(c))
        keys = batch.column(0).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.array(names, pa.binary())], ["key", "at", "name"])

    return map_arrow(lean.select("key", "text"), run, "key long, at int, name binary")


def shared_chunks(named: DataFrame) -> DataFrame:
    """(key, marks) of texts with chunks that occur again: marks are (at, name, first)."""
    again = named.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("holder")).where("n > 1")
    each = named.join(again.select("name", "holder"), "name").withColumn("first", F.col("holder") == F.struct("key", "at"))
    return each.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "name", "first"))).alias("marks"))


def _finish(rows: list[bytes], coder: Coder, digest: bool) -> list[pa.Array]:
    back = [coder.decode(x) for x in rows]
    n = pa.array([len(x) // 4 for x in rows], pa.int64())
    if digest:
        return [n, *(pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (rows, back))]
    return [n, pa.array(rows, pa.binary()), pa.array(back, pa.binary())]


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    lean = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary")

    marks = staging.put(shared_chunks(staging.put(_named(lean, vocabulary))))
    staging.drop(1)
    slot = F.pmod(F.xxhash64("key"), F.lit(64 * MARK_WORDS))
    word, bit = F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")
    bits = marks.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = staging.put(bits)
    told = lean.select("key", "doc_id", "text", word, bit).join(F.broadcast(bits), "word", "left")
    moved: Column = F.coalesce(F.expr("getbit(bits, bit)"), F.lit(0)) == 1

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = coder_of(vocabulary)
        return pa.RecordBatch.from_arrays([batch.column(0), *_finish([coder.encode(t or b"") for t in texts_of(batch.column(1))], coder, digest)], ["doc_id", *names])

    alone = map_arrow(told.where(~moved).select("doc_id", "text"), whole, schema)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Parts of a text: chunks whose ids come from the table, those it publishes, and what is between."""
        coder, rows, out = coder_of(vocabulary), [], []
        for i, (t, own) in enumerate(zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
            parts = chunks(t or b"")
            own = {m["at"]: m for m in own or []}
            run: list[bytes] = []

            def put(k: int, name: bytes | None, shared: bool, text: bytes | None, i=i) -> None:
                rows.append(i)
                out.append((k, name, shared, *(coder.segment(text) if text is not None else (None,) * 6)))

            for k, c in enumerate(parts):
                if k not in own:
                    run.append(c)
                    continue
                if run:
                    put(k - 1, None, False, b"".join(run))
                    run = []
                put(k, own[k]["name"], not own[k]["first"], c if own[k]["first"] else None)
            if run or not parts:
                put(len(parts), None, False, b"".join(run))
        ids = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(2)]
        kinds = [pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*ids, *cols], ["row", "doc_id", *(c.split()[0] for c in _SEGMENT.split(", "))])

    some = told.where(moved).select("key", "doc_id", "text").join(marks, "key", "left")
    some = some.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "marks")
    parts = staging.put(map_arrow(some, split, f"row long, doc_id {kind}, {_SEGMENT}"))
    staging.drop(2)
    told_once = ["ids", "head", "tail", "n_head", "n_tail", "bare"]
    table = parts.where("name is not null and not shared").groupBy("name").agg(*[F.first(c).alias(c) for c in told_once])
    got = parts.where("shared").select("row", "doc_id", "at", "name").join(table, "name").select("row", "doc_id", F.struct("at", *told_once).alias("s"))
    each = parts.where("not shared").select("row", "doc_id", F.struct("at", *told_once).alias("s")).union(got)
    each = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("s")).alias("parts"))

    def repaired(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = coder_of(vocabulary)
        rows = [coder.join([tuple(s[c] for c in told_once) for s in parts]) for parts in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *_finish(rows, coder, digest)], ["doc_id", *names])

    return alone.union(map_arrow(each.select("doc_id", "parts"), repaired, schema))
