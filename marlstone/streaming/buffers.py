"""Buffers between a producer and consumers in one driver: a ring that overwrites, and one that makes the producer wait."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class RingBuffer:
    """The last `size` rows; older ones give way. Rows can be read as a DataFrame."""

    def __init__(self, size: int):
        if size < 1:
            raise ValueError("a ring holds one row at least")
        self.rows: deque[tuple] = deque(maxlen=size)
        self.lost = 0
        self.lock = threading.Lock()

    def put(self, row: tuple) -> None:
        with self.lock:
            self.lost += len(self.rows) == self.rows.maxlen
            self.rows.append(row)

    def take(self) -> tuple | None:
        """The oldest row, or None."""
        with self.lock:
            return self.rows.popleft() if self.rows else None

    def frame(self, spark: SparkSession, schema: str) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), schema)


class BoundedBuffer:
    """At most `size` rows; put waits for room, take for a row, until the buffer is closed."""

    def __init__(self, size: int):
        self.size, self.rows, self.closed = size, deque(), False
        self.changed = threading.Condition()

    def put(self, row: tuple, wait: float | None = None) -> bool:
        with self.changed:
            if not self.changed.wait_for(lambda: self.closed or len(self.rows) < self.size, wait) or self.closed:
                return False
            self.rows.append(row)
            self.changed.notify_all()
            return True

    def take(self, wait: float | None = None) -> tuple | None:
        with self.changed:
            self.changed.wait_for(lambda: self.closed or self.rows, wait)
            row = self.rows.popleft() if self.rows else None
            self.changed.notify_all()
            return row

    def close(self) -> None:
        with self.changed:
            self.closed = True
            self.changed.notify_all()

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.take()) is not None:
            yield row
