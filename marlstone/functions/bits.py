"""Bit functions on 32-bit integers and arrays of them; bit 0 is the lowest of the first element.

Scalars count as arrays of one. Results are arrays unless the function gives a number. Null in,
null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def as_words(value: Column, is_array: bool = False) -> Column:
    """Array of unsigned 32-bit words, kept as longs."""
    array = value if is_array else F.when(value.isNotNull(), F.array(value))
    return F.transform(array, lambda x: x.cast("long").bitwiseAND(F.lit(MASK)))


def signed(word: Column) -> Column:
    """Signed 32-bit integer of an unsigned word."""
    return F.when(word >= 2**31, word - 2**32).otherwise(word).cast("int")


def _paired(a: Column, b: Column, op) -> Column:
    zero = F.lit(0).cast("long")
    return F.zip_with(a, b, lambda x, y: op(F.coalesce(x, zero), F.coalesce(y, zero)))


def bit_and(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x.bitwiseXOR(y))


def bit_not(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(MASK) - x)


def bit_size(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a) * 32)


def bit_count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


def bit_list(a: Column) -> Column:
    """Set bits in ascending order; a single -1 when there is none."""
    each = F.flatten(
        F.transform(a, lambda x, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit(x, b) == 1), lambda b: b + i * 32))
    )
    return F.when(F.size(each) == 0, F.array(F.lit(-1))).otherwise(each)


def bit_min(a: Column) -> Column:
    return F.array_min(bit_list(a))


def bit_max(a: Column) -> Column:
    return F.array_max(bit_list(a))


def bit_is_set(a: Column, n: Column) -> Column:
    word = F.get(a, F.floor(n / 32).cast("int"))
    return F.when(a.isNotNull(), F.coalesce(F.getbit(word, F.pmod(n, F.lit(32))), F.lit(0).cast("tinyint")).cast("int"))


def _pad(a: Column, n: Column) -> Column:
    missing = F.greatest(F.floor(n / 32).cast("int") + 1 - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(0).cast("long"), missing))


def _one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(32)).cast("int"))


def bit_set(a: Column, n: Column) -> Column:
    return F.transform(_pad(a, n), lambda x, i: F.when(i == F.floor(n / 32), x.bitwiseOR(_one(n))).otherwise(x))


def bit_clear(a: Column, n: Column) -> Column:
    return F.transform(_pad(a, n), lambda x, i: F.when(i == F.floor(n / 32), x.bitwiseAND(F.lit(MASK) - _one(n))).otherwise(x))


def _moved(a: Column, n: Column, at) -> Column:
    """Each word from the two that a shift by n puts into it; at gives the place a word comes from."""
    n = n.cast("long")
    words, rest = F.floor(n / 32), F.pmod(n, F.lit(32)).cast("int")

    def word(i: Column) -> Column:
        return F.coalesce(F.get(a, at(i).cast("int")), F.lit(0).cast("long"))

    def one(_: Column, i: Column) -> Column:
        low = F.call_function("shiftleft", word(i - words), rest)
        high = F.call_function("shiftright", word(i - words - 1), F.lit(32) - rest)
        return low.bitwiseOR(high).bitwiseAND(F.lit(MASK))

    return F.transform(a, one)


def bit_shift_left(a: Column, n: Column) -> Column:
    """Unsigned shift across the whole array; a negative count shifts right."""
    return _moved(a, n, lambda i: i)


def bit_shift_right(a: Column, n: Column) -> Column:
    return bit_shift_left(a, -n)


def bit_rotate_left(a: Column, n: Column) -> Column:
    """Rotation across the whole array."""
    return _moved(a, n, lambda i: F.pmod(i, F.size(a)))


def bit_rotate_right(a: Column, n: Column) -> Column:
    return bit_rotate_left(a, -n)
