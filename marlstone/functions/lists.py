"""String lists and fixed arrays.

`in` is asymmetric: a scalar in a list is membership, a list in a list is the subset relation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class IllegalOperation(ValueError):
    """An operator was given operands it has no meaning for."""


def to_list(text: Column, mode: str = "lastchar", separator: str = ",") -> Column:
    """List from text. `lastchar`: the last character delimits; `create`: a given separator; `json`."""
    if mode == "json":
        return F.from_json(text, "array<string>")
    if mode == "create":
        return F.split(text, re.escape(separator), -1)
    if mode != "lastchar":
        raise ValueError(f"unknown mode {mode!r}")
    last, body = F.right(text, F.lit(1)), F.left(text, F.length(text) - 1)
    empty = F.array().cast("array<string>")
    # split by the delimiter as a literal
    parts = F.split(body, F.concat(F.lit(r"\Q"), last, F.lit(r"\E")), -1)
    return F.when(text.isNull(), None).when(F.length(text) <= 1, empty).otherwise(parts)


DELIMITERS = ",|;:\t"


def to_text(items: Column, mode: str = "delimited") -> Column:
    """Text from a list: joined by the first delimiter that no item holds, which also ends it."""
    if mode == "json":
        return F.to_json(items)

    def held(c: str) -> Column:
        return F.exists(items, lambda x: F.contains(x, F.lit(c)))

    best = F.lit(DELIMITERS[-1])
    for c in reversed(DELIMITERS):
        best = F.when(held(c), best).otherwise(F.lit(c))
    text = F.aggregate(items, F.lit(""), lambda a, x: F.concat(a, x, best))
    return F.when(items.isNotNull(), text)


def member(value: Column, items: Column) -> Column:
    return F.array_contains(items, value)


def subset(items: Column, of: list[str]) -> Column:
    """Every item is one of `of`; the empty list is."""
    return F.size(F.array_except(items, F.array(*[F.lit(x) for x in of]).cast("array<string>"))) == 0


def equal(items: Column, other: list[str]) -> Column:
    return items == F.array(*[F.lit(x) for x in other]).cast("array<string>")


def matches(value: Column, pattern: str, is_list: bool = False) -> Column:
    """LIKE with % and _; for a list, whether some element matches."""
    return F.exists(value, lambda x: x.like(pattern)) if is_list else value.like(pattern)


def literal_matches(pattern: str, value: Column, is_list: bool = True) -> Column:
    if is_list:
        raise IllegalOperation("a literal can't match a list; put the list on the left")
    return F.lit(pattern).like(value)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the order of elements, then of lengths."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def fixed(items: Column, n: int, fill: Column | None = None) -> Column:
    """Array of n elements: longer ones are cut, shorter ones filled with zero."""
    filler = F.lit(0) if fill is None else fill
    return F.slice(F.concat(items, F.array_repeat(filler, n)), 1, n)


def to_numbers(items: Column, kind: str = "double") -> Column:
    """Numbers of strings; what is none gives 0."""
    return F.transform(items, lambda x: F.coalesce(F.trim(x).try_cast(kind), F.lit(0).cast(kind)))


def from_numbers(items: Column) -> Column:
    return F.transform(items, lambda x: x.cast("string"))
