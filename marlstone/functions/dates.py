"""Date functions: parts, running numbers, arithmetic in seconds, lenient parsing, calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def week(d: Column) -> Column:
    """Week of the year; week 1 begins on the first Sunday, days before it are week 0."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def month_seq(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def week_seq(d: Column) -> Column:
    """Weeks since a Sunday long ago."""
    return F.floor(F.datediff(d, F.lit("1970-01-04").cast("date")) / 7).cast("int")


def day_seq(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def add_seconds(d: Column, n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(d.cast("timestamp")) + n)


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))


def parse(text: Column, now: Column | None = None) -> Column:
    """Timestamp of `now[+-n]`, `today[+-n]`, `m/d/y` (two-digit years below 70 are 20yy) or ISO text.

    Offsets count seconds. What is none of these gives null.
    """
    now = F.current_timestamp() if now is None else now
    t = F.lower(F.trim(text))
    word = r"^(now|today)\s*(?:([+-])\s*(\d+))?$"
    amount = F.coalesce(F.regexp_extract(t, word, 3).try_cast("long"), F.lit(0))
    moved = F.when(F.regexp_extract(t, word, 2) == "-", -amount).otherwise(amount)
    base = F.when(F.regexp_extract(t, word, 1) == "today", F.date_trunc("day", now)).otherwise(now)
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    m, d, y = (F.regexp_extract(t, slash, i).try_cast("int") for i in (1, 2, 3))
    full = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    by_slash = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", full, m, d), F.lit("yyyy-MM-dd"))
    return F.when(t.rlike(word), F.timestamp_seconds(F.unix_timestamp(base) + moved)).when(t.rlike(slash), by_slash).otherwise(F.try_to_timestamp(F.trim(text)))


def julian_day(d: Column) -> Column:
    """Julian day number at noon of a date."""
    return day_seq(d) + 2440588


def easter(year: Column) -> Column:
    """Date of Gregorian Easter Sunday, by the anonymous computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    at = h + m - 7 * n + 114
    return F.make_date(year, div(at, 31), at % 31 + 1)


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """n-th given weekday (1 = Sunday) of a month; the last one for n = -1."""
    if n > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(weekday) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.dayofweek(last) - F.lit(weekday), F.lit(7)))


def us_holidays(year: Column) -> dict[str, Column]:
    """Federal holidays of a year, without moves to weekdays."""
    day = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    return {
        "new_year": day(1, 1), "king": _nth_weekday(year, 1, 2, 3), "presidents": _nth_weekday(year, 2, 2, 3), "memorial": _nth_weekday(year, 5, 2, -1),
        "juneteenth": day(6, 19), "independence": day(7, 4), "labor": _nth_weekday(year, 9, 2, 1), "columbus": _nth_weekday(year, 10, 2, 2),
        "veterans": day(11, 11), "thanksgiving": _nth_weekday(year, 11, 5, 4), "christmas": day(12, 25),
    }
