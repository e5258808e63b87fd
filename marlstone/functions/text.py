"""Text functions: comparison, replacement, wildcards, matchers, stemming, URLs, hashes."""

from __future__ import annotations

import html
import quopri
import re
import unicodedata
from email.header import decode_header, make_header
from functools import cache, lru_cache
from urllib.robotparser import RobotFileParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLATIONS = {"case": "UTF8_BINARY", "nocase": "UTF8_LCASE", "fold": "UNICODE_CI_AI"}


def string_compare(a: Column, b: Column, mode: str = "case") -> Column:
    """-1, 0 or 1; a null raises an error."""
    x, y = F.collate(a, COLLATIONS[mode]), F.collate(b, COLLATIONS[mode])
    order = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("string_compare needs two values")).cast("int")).otherwise(order)


def replace_pairs(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Search and replace by several patterns, one after the other."""
    for find, put in pairs:
        text = F.regexp_replace(text, translate_pattern(find), put)
    return text


#: Named classes of the search dialect.
NAMED = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "space": r"\s", "upper": "A-Z", "lower": "a-z", "punct": r"\p{Punct}"}


def translate_pattern(pattern: str) -> str:
    r"""The common part of the search dialect as a Java pattern.

    `>>` anchors at its place, `\P` excludes what precedes it and `\F` what follows it from the match,
    and `\digit` and the like name classes. What has no counterpart raises ValueError.
    """
    if r"\P" in pattern:
        before, _, pattern = pattern.partition(r"\P")
        return f"(?<={translate_pattern(before)}){translate_pattern(pattern)}"
    if r"\F" in pattern:
        pattern, _, after = pattern.partition(r"\F")
        return f"{translate_pattern(pattern)}(?={translate_pattern(after)})"
    pattern = pattern.replace(">>", "")
    for name, chars in NAMED.items():
        pattern = re.sub(rf"\[([^\]]*)\\{name}", lambda m, c=chars: f"[{m[1]}{c}", pattern).replace(rf"\{name}", f"[{chars}]")
    try:
        re.compile(pattern.replace(r"\p{Punct}", "!"))
    except re.error as e:
        raise ValueError(f"no counterpart for {pattern!r}") from e
    return pattern


def tokenise(text: Column, patterns: list[str]) -> Column:
    """Matches of several patterns: the earliest first, of equals the longest pattern."""
    return F.regexp_extract_all(text, F.lit("|".join(f"(?:{p})" for p in sorted(patterns, key=len, reverse=True))), F.lit(0))


def wildcard(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """`*` and `?` over the whole text."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return text.rlike(f"(?s{'i' if ignore_case else ''})^{body}$")


def common_cut(text: str, template: str, most: int | None = None, least: int = 0) -> str:
    """text without the prefix and suffix it shares with a template, cut at word boundaries."""
    n, most = min(len(text), len(template)), len(text) if most is None else most
    head = next((i for i in range(n) if text[i] != template[i]), n)
    tail = next((i for i in range(n - head) if text[-1 - i] != template[-1 - i]), n - head)
    while 0 < head < len(text) and text[head - 1].isalnum() and text[head].isalnum():
        head -= 1
    while 0 < tail < len(text) and text[-tail].isalnum() and text[-tail - 1].isalnum():
        tail -= 1
    head, tail = (min(x, most) if x >= least else 0 for x in (head, tail))
    return text[head : len(text) - tail]


def remove_common(text: Column, template: Column, most: int | None = None, least: int = 0) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or y is None else common_cut(x, y, most, least) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(text, template)


def closeness(window: str, pattern: str) -> float:
    """Share of the best sum of position agreement: each character of the pattern counts by how near
    the window holds it to its own place."""
    n = len(pattern)
    got = sum(max((n - abs(j - i) for j in range(len(window)) if window[j] == c), default=0) for i, c in enumerate(pattern))
    return got / (n * n)


def best_closeness(text: str | None, pattern: str, percent: int) -> int | None:
    """Best closeness, in percent, of any part as long as the pattern; null below `percent`.

    For each character of the pattern, its best place in every part at once: parts start where one
    of its characters stands.
    """
    if not text:
        return None
    wanted, low = pattern.lower(), text.lower()
    n = len(wanted)
    codes = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
    padded = np.concatenate([codes, np.zeros(n, dtype=np.uint32)])
    letters = np.frombuffer(wanted.encode("utf-32-le"), dtype=np.uint32)
    starts = np.flatnonzero(np.isin(codes[: max(1, len(low) - n + 1)], letters))
    total = np.zeros(len(starts), dtype=np.int64)
    for i, c in enumerate(letters):
        best = np.zeros(len(starts), dtype=np.int64)
        for j in range(n):
            np.maximum(best, np.where(padded[starts + j] == c, n - abs(j - i), 0), out=best)
        total += best
    top = int(total.max(initial=0) / (n * n) * 100)
    return top if top >= percent else None


def approximate(text: Column, pattern: str, percent: int = 90) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([best_closeness(t, pattern, percent) for t in s], dtype="Int32")

    return run(text)


# Names of numbers.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "dozen": 12}
_NUMBER = re.compile(r"-?\d[\d,]*(?:\.\d+)?|[a-z]+", re.IGNORECASE)


def numbers_in(text: str) -> list[float]:
    """Numbers of a text, in digits or words; `ten million` is one number."""
    out, total, part, on = [], 0.0, 0.0, False

    def close() -> None:
        nonlocal total, part, on
        if on:
            out.append(total + part)
        total, part, on = 0.0, 0.0, False

    for word in _NUMBER.findall(text.lower()):
        if word in UNITS or word in TENS:
            part, on = part + (UNITS.get(word) if word in UNITS else TENS[word]), True
        elif word in SCALES and (on or word != "dozen"):
            scale, on = SCALES[word], True
            if scale <= 100:
                part = (part or 1) * scale
            else:
                total, part = total + (part or 1) * scale, 0.0
        elif word[0].isdigit() or word[0] == "-":
            close()
            part, on = float(word.replace(",", "")), True
        elif word != "and":
            close()
    close()
    return out


def numeric_test(query: str):
    """`>5`, `<=5`, `1,10` (range), `any`, or a number to equal."""
    q = query.strip().lower()
    if q == "any":
        return lambda x: True
    if m := re.match(r"^(>=|<=|>|<|=)\s*(.+)$", q):
        n = numbers_in(m[2])[0]
        return {">": lambda x: x > n, "<": lambda x: x < n, ">=": lambda x: x >= n, "<=": lambda x: x <= n, "=": lambda x: x == n}[m[1]]
    if m := re.match(r"^\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*$", q):
        low, high = float(m[1]), float(m[2])
        return lambda x: low <= x <= high
    n = numbers_in(q)[0]
    return lambda x: x == n


def numeric_match(text: Column, query: str) -> Column:
    """Whether some number of the text passes a numeric query."""
    numeric_test(query)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        test = numeric_test(query)
        return s.map(lambda t: None if t is None else any(test(x) for x in numbers_in(t)))

    return run(text)


def register(spark) -> None:
    """approximate(text, pattern, percent) and numeric_match(text, query) for SQL."""
    if spark.catalog.functionExists("numeric_match"):
        return

    @F.pandas_udf("int")
    def near(texts: pd.Series, patterns: pd.Series, percents: pd.Series) -> pd.Series:
        return pd.Series([best_closeness(t, p, int(n)) for t, p, n in zip(texts, patterns, percents, strict=True)], dtype="Int32")

    @F.pandas_udf("boolean")
    def number(texts: pd.Series, queries: pd.Series) -> pd.Series:
        test = lru_cache(maxsize=64)(numeric_test)
        return pd.Series([t is not None and any(map(test(q), numbers_in(t))) for t, q in zip(texts, queries, strict=True)])

    spark.udf.register("approximate", near)
    spark.udf.register("numeric_match", number)


# Suffixes that stemming strips, longest first.
SUFFIXES = ("ization", "ational", "fulness", "ousness", "iveness", "ingly", "edly", "ments", "ment", "ness", "tion", "ing", "ies", "ed", "es", "ly", "er", "s")


def stem_pattern(least: int = 3) -> str:
    return rf"^(.{{{least},}}?)(?:{'|'.join(SUFFIXES)})$"


def stem(word: Column, least: int = 3) -> Column:
    """The word without its first fitting suffix, unless fewer than `least` letters would stay."""
    return F.regexp_replace(word, stem_pattern(least), "$1")


def stem_word(word: str, least: int = 3) -> str:
    """As stem, for one word of a query."""
    return re.sub(stem_pattern(least), r"\1", word)


@cache
def folding() -> dict[int, str | None]:
    """Latin, Greek and Cyrillic letters with marks by the letter without; marks of their own go."""
    out: dict[int, str | None] = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and len(base.lower()) == 1:
            out[code] = base.lower()
    return out | dict.fromkeys(range(0x300, 0x370))


def folding_pair() -> tuple[str, str]:
    """What translate takes: letters with marks, and then marks, by letters without."""
    letters = {chr(k): v for k, v in folding().items() if v}
    marks = "".join(chr(k) for k, v in folding().items() if not v)
    return "".join(letters) + marks, "".join(letters.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *folding_pair())


def url_parts(url: Column) -> dict[str, Column]:
    part = lambda p: F.try_parse_url(url, F.lit(p))
    user = part("USERINFO")
    return {
        "protocol": part("PROTOCOL"), "host": part("HOST"), "path": part("PATH"), "query": part("QUERY"), "anchor": part("REF"),
        "port": F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1).try_cast("int"), "user": F.substring_index(user, ":", 1),
        "password": F.when(F.instr(user, ":") > 0, F.substring_index(user, ":", -1)),
    }


def _mapped(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


def unescape_html(text: Column) -> Column:
    return _mapped(html.unescape)(text)


def decode_quoted(text: Column) -> Column:
    return _mapped(lambda t: quopri.decodestring(t.encode()).decode("utf-8", "replace"))(text)


def decode_words(text: Column) -> Column:
    """Encoded words of mail headers."""
    return _mapped(lambda t: str(make_header(decode_header(t))))(text)


def robots_allowed(agent: str, robots: Column, url: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(r: pd.Series, u: pd.Series) -> pd.Series:
        @lru_cache(maxsize=256)
        def parsed(text: str) -> RobotFileParser:
            parser = RobotFileParser()
            parser.parse(text.splitlines())
            return parser

        return pd.Series([parsed(a or "").can_fetch(agent, b or "/") for a, b in zip(r, u, strict=True)])

    return run(robots, url)


_MURMUR = 0xC6A4A7935BD1E995
_64 = (1 << 64) - 1


def murmur64(data: bytes, seed: int = 0xFEEDCEED) -> int:
    """MurmurHash64A, unsigned."""
    h = seed ^ (len(data) * _MURMUR & _64)
    whole = len(data) & ~7
    for at in range(0, whole, 8):
        k = int.from_bytes(data[at : at + 8], "little") * _MURMUR & _64
        h = (h ^ ((k ^ (k >> 47)) * _MURMUR & _64)) * _MURMUR & _64
    if rest := data[whole:]:
        h = (h ^ int.from_bytes(rest, "little")) * _MURMUR & _64
    h = (h ^ (h >> 47)) * _MURMUR & _64
    return h ^ (h >> 47)


def hash64(text: Column) -> Column:
    """MurmurHash64A of UTF-8 text as a signed long; xxhash64 is faster where bits needn't match."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return s.map(lambda t: None if t is None else signed(murmur64(t.encode()))).astype("Int64")

    return run(text)


def ngram_profile(rows: DataFrame, text: str, by: list[str], n: int = 3) -> DataFrame:
    """Counts of character n-grams of lower-cased text for each group."""
    chars = rows.select(*by, F.filter(F.split(F.lower(F.col(text)), ""), lambda c: c != "").alias("_c")).where(F.size("_c") >= n)
    # the characters are a column of their own: a lambda would cut them from the text for each place
    grams = F.transform(F.sequence(F.lit(0), F.size("_c") - n), lambda i: F.concat(*[F.get("_c", i + j) for j in range(n)]))
    return chars.select(*by, F.explode(grams).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("n"))


def profile_language(rows: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """(key, lang, cosine): the profile (lang, gram, n) with the largest cosine; ties by name."""
    norm = profiles.groupBy("lang").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    grams = ngram_profile(rows, text, [key])
    own = grams.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own"))
    p = profiles.select("lang", "gram", F.col("n").alias("m"))
    sums = grams.join(p, "gram").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = sums.join(norm, "lang").join(own, key).withColumn("cosine", F.col("dot") / F.col("norm") / F.col("own"))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("lang"))).alias("b")
    return scored.groupBy(key).agg(best).select(key, "b.lang", (-F.col("b.c")).alias("cosine"))


def suggest(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion, edits): the most frequent vocabulary (term, df) word within `most` edits.

    Both sides are spread over their forms with up to `most` letters left out, so that only words
    that share one meet; the edit distance then decides. Vocabulary words whose length is further
    than `most` from that of every word can't be suggested and are not spread.
    """

    def forms(c: Column) -> Column:
        def less(a: Column) -> Column:
            cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
            return F.array_union(a, F.flatten(F.transform(a, cut)))

        out = F.array(c)
        for _ in range(most):
            out = less(out)
        return F.explode(F.array_distinct(out))

    a = words.select("word").distinct().select("word", forms(F.col("word")).alias("form"))
    lengths = words.select(F.explode(F.sequence(F.length("word") - most, F.length("word") + most)).alias("n")).distinct()
    near = vocabulary.join(F.broadcast(lengths), F.length("term") == F.col("n"), "left_semi")
    b = near.select("term", "df", forms(F.col("term")).alias("form"))
    edits = F.levenshtein("word", "term")
    pairs = a.join(b, "form").select("word", "term", "df").distinct().withColumn("edits", edits).where((F.col("edits") <= most) & (F.col("edits") > 0))
    best = F.min(F.struct("edits", (-F.col("df")).alias("d"), "term")).alias("b")
    return pairs.groupBy("word").agg(best).select("word", F.col("b.term").alias("suggestion"), F.col("b.edits").alias("edits"))
