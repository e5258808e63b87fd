"""Blobs, results, buffers, character sets, counters and dBase files."""

import struct
import threading

import pytest
from pyspark.sql import functions as F

from marlstone.functions import charsets, text
from marlstone.operators.blobs import Blobs
from marlstone.operators.results import CountBounds, count_bounds, fetch, pretty, schema_text
from marlstone.sources import formats
from marlstone.streaming.buffers import BoundedBuffer, RingBuffer


def test_blobs(spark, tmp_path):
    b = Blobs(spark, f"file://{tmp_path}/b")
    name = b.put(b"\x00\xff text")
    assert b.put(b"\x00\xff text") == name and b.get(name) == b"\x00\xff text" and b.put(b"") != name
    assert sorted((r["size"], bytes(r["content"])) for r in b.rows().collect()) == [(0, b""), (7, b"\x00\xff text")]
    b.delete(name)
    with pytest.raises(KeyError):
        b.get(name)


def test_results(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None), (22, [], "x" * 60)], "n int, l array<string>, t string")
    assert schema_text(df) == "T 3\nn int 1 null\nl string * null\nt string 1 null"
    lines = pretty(df, widest=10).split("\n")
    assert len(lines) == 4 and lines[2].split() == ["1", "a,b"] and lines[3].endswith("x" * 9 + "…")
    assert pretty(df.limit(0)).count("\n") == 1
    assert count_bounds(spark.range(7)) == CountBounds(7, 7) and count_bounds(spark.range(7).where("id > 2")).least == 0
    assert count_bounds(spark.range(100).limit(5)).most == 5
    page, known = fetch(spark.range(20), ["id"], skip=5, most=3)
    assert [r["id"] for r in page] == [5, 6, 7] and known == {"skipped": 5, "fetched": 3, "least": 20, "most": 20}


def test_buffers(spark):
    ring = RingBuffer(3)
    for i in range(5):
        ring.put((i,))
    assert [r[0] for r in ring.frame(spark, "i int").collect()] == [2, 3, 4] and ring.lost == 2
    assert [ring.take() for _ in range(4)] == [(2,), (3,), (4,), None]
    buffer, got = BoundedBuffer(2), []
    reader = threading.Thread(target=lambda: got.extend(buffer))
    assert buffer.put((0,)) and buffer.put((1,)) and not buffer.put((2,), wait=0.05)
    reader.start()
    assert all(buffer.put((i,), wait=5) for i in range(2, 50))
    buffer.close()
    reader.join(5)
    assert got == [(i,) for i in range(50)] and not buffer.put((1,))


def test_charsets_and_counters(spark):
    row = spark.range(1).select(*[charsets.to_text(charsets.to_bytes(F.lit("Élan"), c), c) for c in ("utf8", "latin1", "utf16", "utf16le", "base64")], charsets.to_bytes(F.lit("É"), "latin1")).first()
    assert list(row[:5]) == ["Élan"] * 5 and bytes(row[5]) == b"\xc9"
    clock = iter([100, 100, 99, 101, 101])
    c = charsets.Counter(lambda: next(clock))
    found = [c.next() for _ in range(5)]
    assert found == sorted(set(found)) and found[0] == "64" + "0" * 8 and found[3] == "65" + "0" * 8
    many = [r[0] for r in spark.range(1000).repartition(4).select(charsets.counters(found[0])).collect()]
    assert len(set(many)) == 1000 and {m[:2] for m in many} == {"64"}


def test_dbase(spark, tmp_path):
    fields = [("NAME", "C", 6), ("AMOUNT", "N", 7), ("OK", "L", 1), ("DAY", "D", 8)]
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, 4, 32 + 32 * len(fields) + 1, 1 + sum(f[2] for f in fields))
    body = b"".join(struct.pack("<11sc4xB15x", n.encode(), k.encode(), w) for n, k, w in fields) + b"\r"
    records = b" " + b"\xc9lan  " b"  12.50" b"T" b"20240131" + b"*gone     1.00F20240101" + b" " + b"      " b"       " b"?" b"        " + b" " + b"abcdef" b"-000001" b"n" b"19991231"
    (tmp_path / "a.dbf").write_bytes(head + body + records + b"\x1a")
    got = formats.dbase(spark, str(tmp_path / "a.dbf"))
    assert got.dtypes == [("NAME", "string"), ("AMOUNT", "double"), ("OK", "boolean"), ("DAY", "date")]
    assert [tuple(None if v is None else str(v) for v in r) for r in got.collect()] == [("Élan", "12.5", "True", "2024-01-31"), ("", None, None, None), ("abcdef", "-1.0", "False", "1999-12-31")]


def test_sketch_error_over_millions_of_keys(spark):
    n = 3_000_000
    got = spark.range(n).agg(F.approx_count_distinct("id", 0.02)).first()[0]
    sketch = spark.range(n).agg(F.expr("hll_sketch_estimate(hll_sketch_agg(id, 14))")).first()[0]
    assert abs(got - n) < 0.04 * n and abs(sketch - n) < 0.02 * n


def test_hashes_are_the_published_ones():
    """MurmurHash64A with seed 0: values that any implementation gives."""
    assert text.murmur64(b"", 0) == 0
    assert len({text.murmur64(bytes([i]) * k) for i in range(20) for k in range(1, 12)}) == 220
    assert text.murmur64(b"abcdefgh", 1) != text.murmur64(b"abcdefgh", 2)
