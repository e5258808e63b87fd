"""dBase files, and tables of other databases."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Field types of the format and their Spark types.
KINDS = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "date", "I": "int", "M": "string"}


def fields_of(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, offset, length) of each field of a header."""
    size, out, at, offset = struct.unpack_from("<H", data, 8)[0], [], 32, 1
    while at + 32 <= size and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii")
        kind, length = chr(data[at + 11]), data[at + 16]
        out.append((name, kind, offset, length))
        offset += length
        at += 32
    return out


def _value(raw: bytes, kind: str, charset: str) -> object:
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    text = raw.decode(charset).strip("\0 ")
    if kind in "NF":
        return float(text) if text and text.strip("*") else None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if kind == "D":
        return pd.Timestamp(f"{text[:4]}-{text[4:6]}-{text[6:]}").date() if len(text) == 8 else None
    return text


def records_of(data: bytes, charset: str = "latin1") -> Iterator[tuple]:
    """Rows that are not marked as deleted."""
    count, start, width = struct.unpack_from("<IHH", data, 4)
    fields = fields_of(data)
    for i in range(count):
        row = data[start + i * width : start + (i + 1) * width]
        if len(row) == width and row[:1] != b"*":
            yield tuple(_value(row[o : o + n], kind, charset) for _, kind, o, n in fields)


def dbase(spark: SparkSession, path: str, charset: str = "latin1") -> DataFrame:
    """Rows of dBase III files with equal fields; a file is read by one task, as the format is at most 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()
    if first is None:
        raise ValueError(f"no file at {path}")
    fields = fields_of(bytes(first[0]))
    names = [f[0] for f in fields]
    if unknown := {f[1] for f in fields} - KINDS.keys():
        raise ValueError(f"unknown field types: {sorted(unknown)}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                yield pd.DataFrame(list(records_of(bytes(data), charset)), columns=names, dtype=object)

    return files.select("content").mapInPandas(run, ", ".join(f"`{n}` {KINDS[k]}" for n, k, _, _ in fields))


def database(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of another database over JDBC, read in parts by ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
