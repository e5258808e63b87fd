"""Readers and writers beyond Spark's own: lines, records, mail, MIME, documents, files in columns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes
from email.message import EmailMessage
from email.policy import default as default_policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import text_of_html


def csv(spark: SparkSession, path: str, header: bool = True, quote: str = '"', escape: str = '"', guess: bool = True) -> DataFrame:
    return spark.read.csv(path, header=header, inferSchema=guess, quote=quote, escape=escape)


def xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def lines(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, most: int | None = None, reverse: bool = False) -> DataFrame:
    """(path, line_no, value) of text files; start and end are patterns of the first and last line kept in a file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    rows = whole
    if start or end:
        marks = whole.groupBy("path").agg(
            F.min(F.when(F.col("value").rlike(start or ""), F.col("line_no"))).alias("first"), F.min(F.when(F.col("value").rlike(end), F.col("line_no"))).alias("last") if end else F.lit(None).cast("int").alias("last")
        )
        rows = whole.join(marks, "path").where("line_no >= first and (last is null or line_no <= last)").select("path", "line_no", "value")
    order = [F.col("path"), F.desc("line_no") if reverse else F.asc("line_no")]
    return rows.orderBy(*order).limit(most) if most is not None else rows.orderBy(*order)


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(path, record_no, value): parts of files between matches of a pattern, empty ones left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", delimiter)).alias("record_no", "value")).where("trim(value) <> ''")


def files(spark: SparkSession, folder: str, allow: str = "*", ignore: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, size, modified, content) of files by glob; hidden ones are left out by Spark."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", allow).option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return found.where(~F.col("path").rlike(ignore)) if ignore else found


def with_file_text(rows: DataFrame, path_column: str, folder: str, as_column: str = "content") -> DataFrame:
    """Adds the text of the file each row names; null where there is none."""
    spark = rows.sparkSession
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("_p"), F.col("value").alias(as_column))
    key = F.regexp_replace(F.col("_p"), "^file:/*", "/")
    return rows.join(text.withColumn("_p", key), F.col(path_column) == F.col("_p"), "left").drop("_p")


def parse_mail(raw: bytes) -> EmailMessage:
    return message_from_bytes(raw, policy=default_policy)


def _mail(raw: bytes) -> dict[str, str | None]:
    m = parse_mail(raw)
    body = m.get_body(preferencelist=("plain", "html"))
    return {k: str(m[k]) if m[k] else None for k in ("date", "from", "to", "subject", "keywords")} | {"body": body.get_content().strip() if body else None}


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, message_no, date, sender, recipient, subject, keywords, body) of mbox files."""
    parts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.posexplode(F.filter(F.split("value", r"(?m)^From .*\r?\n"), lambda x: F.trim(x) != "")).alias("message_no", "raw")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_mail(x.encode()) for x in b["raw"]]
            cols = {"date": "date", "sender": "from", "recipient": "to", "subject": "subject", "keywords": "keywords", "body": "body"}
            yield pd.DataFrame({"path": b["path"], "message_no": b["message_no"], **{c: [f[k] for f in found] for c, k in cols.items()}})

    return parts.mapInPandas(run, "path string, message_no int, date string, sender string, recipient string, subject string, keywords string, body string")


def mime_parts(content: Column) -> Column:
    """array<struct<kind, name, text>> of a message's leaf parts."""

    @F.pandas_udf("array<struct<kind:string,name:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> list[dict] | None:
            if raw is None:
                return None
            leaves = [p for p in parse_mail(bytes(raw)).walk() if not p.is_multipart()]
            return [{"kind": p.get_content_type(), "name": p.get_filename(), "text": p.get_content() if p.get_content_maintype() == "text" else None} for p in leaves]

        return s.map(one)

    return run(content)


def identify(data: bytes) -> str:
    """Kind of a document by its content."""
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return "zip"
        for start, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx"), ("META-INF/container.xml", "epub"), ("content.xml", "odt")):
            if any(n.startswith(start) for n in names):
                return kind
        return "zip"
    head = data[:1000].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "html"
    if head.startswith(b"<?xml"):
        return "xml"
    return "rtf" if head.startswith(b"{\\rtf") else "txt"


def _zip_text(data: bytes, pattern: str, paragraph: str) -> str:
    z, out = zipfile.ZipFile(io.BytesIO(data)), []
    for name in sorted(n for n in z.namelist() if re.match(pattern, n)):
        for node in ElementTree.fromstring(z.read(name)).iter():
            if node.tag.rsplit("}", 1)[-1] in paragraph.split():
                out.append("".join(node.itertext()))
    return "\n".join(x for x in out if x.strip())


#: Converters by kind; others, such as one for PDF, can be added.
CONVERTERS: dict[str, Callable[[bytes], str]] = {
    "docx": lambda d: _zip_text(d, r"word/document\.xml", "p"), "pptx": lambda d: _zip_text(d, r"ppt/slides/slide\d+\.xml", "p"), "odt": lambda d: _zip_text(d, r"content\.xml", "p h"),
    "html": lambda d: text_of_html(d.decode("utf-8", "replace")) or "", "xml": lambda d: "\n".join(x.strip() for x in ElementTree.fromstring(d).itertext() if x.strip()),
    "txt": lambda d: d.decode("utf-8", "replace"),
}


def convert(content: Column) -> Column:
    """struct<kind, text>; text is null for a kind without a converter or a broken document."""
    converters = dict(CONVERTERS)

    @F.pandas_udf("struct<kind:string,text:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        kinds, texts = [], []
        for raw in s:
            data = bytes(raw) if raw is not None else b""
            kinds.append(identify(data))
            try:
                texts.append(converters[kinds[-1]](data) if kinds[-1] in converters else None)
            except (ElementTree.ParseError, KeyError, zipfile.BadZipFile):
                texts.append(None)
        return pd.DataFrame({"kind": kinds, "text": texts})

    return run(content)


def discard(df: DataFrame) -> None:
    """The no-op sink: runs a plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_csv(df: DataFrame, path: str, header: bool = True, separator: str = ",", most: int | None = None) -> None:
    (df.limit(most) if most is not None else df).write.mode("overwrite").csv(path, header=header, sep=separator)


def table_stats(df: DataFrame) -> DataFrame:
    """(column, count, sum, min, max, average) of the numeric columns, in one pass."""
    names = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    figures = [f(c).cast("double").alias(f"{i}_{k}") for i, c in enumerate(names) for k, f in (("n", F.count), ("s", F.sum), ("l", F.min), ("h", F.max), ("a", F.avg))]
    one = df.agg(*figures)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(n) for k, n in (("n", "count"), ("s", "sum"), ("l", "min"), ("h", "max"), ("a", "average"))]) for i, c in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
