"""Math functions whose results differ from Spark's: always double, null in and null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": F.ceil, "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "fabs": F.abs, "floor": F.floor,
    "log": F.ln, "log10": F.log10, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}


def one(name: str, x: Column) -> Column:
    """A one-argument function by name; the result is a double."""
    return ONE[name](x.cast("double")).cast("double")


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def fmod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the dividend; NaN for a divisor of 0."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y != 0, y))


def is_nan(x: Column) -> Column:
    """1 or 0."""
    return F.isnan(x.cast("double")).cast("int")


def random_between(low: int, high: int, seed: int | None = None) -> Column:
    """Whole number from low to high, both included."""
    return (F.floor((F.rand(seed) if seed is not None else F.rand()) * (high - low + 1)) + low).cast("long")
