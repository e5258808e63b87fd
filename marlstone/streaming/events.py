"""Streams: windows with watermarks, duplicates, event fan-out, incremental text index, following files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import TextIndex


def follow_files(spark: SparkSession, folder: str, schema: str, most_files: int | None = None, kind: str = "parquet") -> DataFrame:
    """Rows of files as they arrive; most_files bounds what one batch takes."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.format(kind).load(folder)


def follow_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Without repeats of a key that arrive within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class Bus:
    """Named events with handlers; a stream of (event, payload) fans out to them batch by batch."""

    def __init__(self) -> None:
        self.handlers: dict[str, dict[str, Callable[[DataFrame], None]]] = {}

    def on(self, event: str, name: str, handler: Callable[[DataFrame], None]) -> None:
        self.handlers.setdefault(event, {})[name] = handler

    def off(self, event: str, name: str) -> None:
        self.handlers.get(event, {}).pop(name, None)

    def remove(self, event: str) -> None:
        self.handlers.pop(event, None)

    def trigger(self, rows: DataFrame) -> None:
        for event, named in list(self.handlers.items()):
            part = rows.where(F.col("event") == event)
            for handler in list(named.values()):
                handler(part)

    def attach(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda rows, _: self.trigger(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(docs: DataFrame, index: TextIndex, checkpoint: str, optimize_over: int = 1000) -> StreamingQuery:
    """Adds new rows to a text index's delta and merges it past a number of new rows.

    A batch that runs again after a failure or a restart replaces itself: the index keeps numbers.
    """

    def batch(rows: DataFrame, number: int) -> None:
        index.add(rows, number)
        index.optimize(optimize_over)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
