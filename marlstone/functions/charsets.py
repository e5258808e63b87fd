"""Text between character sets, and running numbers as text."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of character sets and what Spark calls them.
CHARSETS = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "ascii": "US-ASCII", "utf16": "UTF-16", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE"}


def to_text(data: Column, charset: str) -> Column:
    """Text from bytes; base64 is decoded to UTF-8."""
    if charset == "base64":
        return F.decode(F.unbase64(data.cast("string")), "UTF-8")
    return F.decode(data.cast("binary"), CHARSETS[charset])


def to_bytes(text: Column, charset: str) -> Column:
    """Bytes from text; a character that the set lacks is an error."""
    if charset == "base64":
        return F.encode(F.base64(F.encode(text, "UTF-8")), "US-ASCII")
    return F.encode(text, CHARSETS[charset])


class Counter:
    """Values (second, number within it) as hexadecimal text; each is larger than those before it."""

    def __init__(self, clock=time.time):
        self.clock, self.last, self.lock = clock, (0, -1), threading.Lock()

    def next(self) -> str:
        with self.lock:
            second = max(int(self.clock()), self.last[0])
            self.last = (second, self.last[1] + 1 if second == self.last[0] else 0)
            return f"{self.last[0]:x}{self.last[1]:08x}"


def counters(base: str) -> Column:
    """A value like those of Counter for each row: the same second, rising within a partition and distinct over all."""
    second = F.lit(base[:-8])
    number = F.monotonically_increasing_id()
    return F.concat(second, F.lpad(F.lower(F.hex(number)), 16, "0"))
