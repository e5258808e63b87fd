"""The scalar functions by name for SQL text.

Most are SQL functions, which Catalyst inlines, so they cost what their body costs. Their bodies come
from the column functions where these have no lambdas, else from the text below. Functions that build
documents are Arrow UDFs. A few names belong to Spark's own functions of another meaning: RENAMED
says what the dialect calls instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from weakref import WeakKeyDictionary

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dates, geo, jsons, net, text

RENAMED = {"dayname": "day_name", "monthname": "month_name", "week": "week_from_sunday", "isnan": "is_nan_number"}

_S, _T, _L, _D = "string", "timestamp", "bigint", "double"
#: Name: arguments' types, column function.
COLUMNS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "day_name": ((_T,), dates.day_name), "month_name": ((_T,), dates.month_name), "week_from_sunday": ((_T,), dates.week),
    "monthseq": ((_T,), dates.month_seq), "weekseq": ((_T,), dates.week_seq), "dayseq": ((_T,), dates.day_seq),
    "inet2int": ((_S,), net.inet_to_int), "int2inet": ((_L,), net.int_to_inet), "inetnetwork": ((_S,), net.network), "inethost": ((_S,), net.host),
    "inetbroadcast": ((_S,), net.broadcast), "inetnetmask": ((_S,), net.netmask), "inetnetmasklen": ((_S,), net.mask_length), "inetcontains": ((_S, _S), net.contains),
    "inetclass": ((_S,), net.address_class), "inetcanon": ((_S,), net.canonical), "inetabbrev": ((_S,), net.abbreviated),
    "isjson": ((_S,), jsons.is_json), "json_type": ((_S,), jsons.json_type), "haversine": ((_D, _D, _D, _D), geo.haversine), "foldtext": ((_S,), text.fold),
    "stem": ((_S,), text.stem),
}

_KIND = (
    "CASE WHEN v IS NULL THEN NULL WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'OBJECT' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'ARRAY' WHEN schema_of_variant(v) = 'VOID' THEN 'NULL' "
    "WHEN schema_of_variant(v) RLIKE '^(DECIMAL|DOUBLE|FLOAT)' THEN 'DOUBLE' ELSE 'OTHER' END"
)
#: Name and arguments: type and body.
BODIES = {
    "bitand(a int, b int)": ("int", "a & b"), "bitor(a int, b int)": ("int", "a | b"), "bitxor(a int, b int)": ("int", "a ^ b"), "bitnot(a int)": ("int", "~a"),
    "bitsize(a int)": ("int", "if(a IS NULL, NULL, 32)"), "bitcount(a int)": ("int", "bit_count(CAST(a AS BIGINT) & 4294967295)"),
    "bitlist(a int)": ("array<int>", "CASE WHEN a = 0 THEN array(-1) WHEN a IS NOT NULL THEN filter(sequence(0, 31), i -> shiftrightunsigned(a, i) & 1 = 1) END"),
    "bitmin(a int)": ("int", "array_min(bitlist(a))"), "bitmax(a int)": ("int", "array_max(bitlist(a))"),
    "bitshiftleft(a int, n int)": ("int", "CASE WHEN abs(n) >= 32 THEN 0 WHEN n >= 0 THEN shiftleft(a, n) ELSE shiftrightunsigned(a, -n) END"),
    "bitshiftright(a int, n int)": ("int", "bitshiftleft(a, -n)"),
    "bitrotateleft(a int, n int)": ("int", "shiftleft(a, pmod(n, 32)) | if(pmod(n, 32) = 0, 0, shiftrightunsigned(a, 32 - pmod(n, 32)))"),
    "bitrotateright(a int, n int)": ("int", "bitrotateleft(a, -n)"),
    "bitset(a int, n int)": ("int", "CASE WHEN n BETWEEN 0 AND 31 THEN a | shiftleft(1, n) ELSE raise_error('bit beyond the number') END"),
    "bitclear(a int, n int)": ("int", "if(n BETWEEN 0 AND 31, a & ~shiftleft(1, n), a)"), "bitisset(a int, n int)": ("int", "if(n BETWEEN 0 AND 31, shiftrightunsigned(a, n) & 1, 0)"),
    "is_nan_number(x double)": ("int", "CAST(isnan(x) AS INT)"), "fabs(x double)": ("double", "abs(x)"), "fmod(x double, y double)": ("double", "if(y = 0, NULL, x % y)"),
    "stringcompare(a string, b string, mode string DEFAULT 'case')": (
        "int",
        "CASE WHEN a IS NULL OR b IS NULL THEN raise_error('stringcompare needs two values') WHEN mode = 'case' THEN CAST(sign(if(a < b, -1, if(a > b, 1, 0))) AS INT) "
        "WHEN mode = 'nocase' THEN if(collate(a, 'UTF8_LCASE') < collate(b, 'UTF8_LCASE'), -1, if(collate(a, 'UTF8_LCASE') > collate(b, 'UTF8_LCASE'), 1, 0)) "
        "WHEN mode = 'fold' THEN if(collate(a, 'UNICODE_CI_AI') < collate(b, 'UNICODE_CI_AI'), -1, if(collate(a, 'UNICODE_CI_AI') > collate(b, 'UNICODE_CI_AI'), 1, 0)) ELSE raise_error('unknown mode') END",
    ),
    "sandr(find string, put string, txt string)": ("string", "regexp_replace(txt, find, put)"),
    "urlencode(s string)": ("string", "url_encode(s)"), "urldecode(s string)": ("string", "url_decode(s)"),
    "vecdist(a array<double>, b array<double>, metric string DEFAULT 'dot')": (
        "double",
        "CASE WHEN size(a) <> size(b) THEN NULL WHEN metric = 'dot' THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) "
        "WHEN metric = 'l2sq' THEN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x) "
        "WHEN metric = 'cosine' THEN 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) ELSE raise_error('unknown metric') END",
    ),
    "json_kind_at(v variant)": ("string", _KIND),
    "json_value(doc string, path string)": (
        "string",
        "CASE WHEN doc IS NULL THEN '' WHEN json_kind_at(try_variant_get(try_parse_json(doc), path, 'variant')) IN ('OBJECT', 'ARRAY', 'NULL') THEN '' "
        "WHEN json_kind_at(try_variant_get(try_parse_json(doc), path, 'variant')) = 'DOUBLE' THEN format_string('%.6f', try_cast(get_json_object(doc, path) AS double)) "
        "ELSE coalesce(get_json_object(doc, path), '') END",
    ),
    "json_query(doc string, path string)": (
        "string", "if(json_kind_at(try_variant_get(try_parse_json(doc), path, 'variant')) IN ('OBJECT', 'ARRAY'), get_json_object(doc, path), '')",
    ),
    "strlst(txt string)": (
        "array<string>",
        "CASE WHEN txt IS NULL THEN NULL WHEN length(txt) <= 1 THEN CAST(array() AS array<string>) ELSE split(left(txt, length(txt) - 1), concat('\\\\Q', right(txt, 1), '\\\\E'), -1) END",
    ),
}


def _modified(doc: str | None, where: str | None, value: str | None) -> str | None:
    if doc is None or where is None:
        return None
    try:
        document = json.loads(doc)
    except ValueError:
        return None
    try:
        value = json.loads(value) if value is not None else None
    except ValueError:
        pass  # not JSON: a string
    return jsons._dump(jsons.modify(document, where.removeprefix("append ").strip(), value, where.startswith("append ")))


def _udfs() -> dict[str, Callable]:
    @F.pandas_udf("string")
    def modify(docs: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_modified(*x) for x in zip(docs, paths, values, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def pretty(docs: pd.Series, indents: pd.Series) -> pd.Series:
        def one(doc: str | None, indent: int) -> str | None:
            try:
                return json.dumps(json.loads(doc), indent=int(indent), ensure_ascii=False)
            except (TypeError, ValueError):
                return doc

        return pd.Series([one(*x) for x in zip(docs, indents, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, templates: pd.Series, most: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or m is None else text.common_cut(t, m, int(a), int(b)) for t, m, a, b in zip(texts, templates, most, least, strict=True)], dtype=object)

    return {
        "json_modify": modify, "json_pretty": pretty, "json_merge_patch": jsons._pairwise(jsons.merge_patch), "json_merge_preserve": jsons._pairwise(jsons.merge_preserve),
        "rmcommon": cut, "inettoipv4": net._converted(4), "inettoipv6": net._converted(6), "htmldecode": text._mapped(text.html.unescape),
    }


UDFS = frozenset("json_modify json_pretty json_merge_patch json_merge_preserve rmcommon inettoipv4 inettoipv6 htmldecode".split())
_HEADS = {head.split("(")[0]: head for head in BODIES}
#: Sessions and the functions each knows already.
_KNOWN: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()


def called(sql: str) -> set[str]:
    """Names of these functions that a text calls, and of those that their bodies call."""
    found = {n.lower() for n in re.findall(r"\b([A-Za-z_]\w*)\s*\(", sql)} & (COLUMNS.keys() | _HEADS.keys() | UDFS | {"generate_uuid", "approximate", "numeric_match"})
    for name in found & _HEADS.keys():
        if inner := called(BODIES[_HEADS[name]][1]) - {name}:
            found = found | inner
    return found


def register(spark: SparkSession, names: set[str] | None = None) -> None:
    """Makes functions known to a session, all without names; what it knows already is left alone."""
    known = _KNOWN.setdefault(spark, set())
    wanted = (COLUMNS.keys() | _HEADS.keys() | UDFS | {"generate_uuid", "numeric_match"} if names is None else names) - known
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    for name in [*(n for n in wanted if n not in _HEADS), *(n for n in _HEADS if n in wanted)]:  # bodies call those before them
        if name in UDFS:
            spark.udf.register(name, _udfs()[name])
        elif name in COLUMNS:
            kinds, f = COLUMNS[name]
            args = [(f"a{i}", k) for i, k in enumerate(kinds)]
            out = spark.createDataFrame([], ", ".join(f"{a} {k}" for a, k in args)).select(f(*[F.col(a) for a, _ in args]).alias("r"))
            body = out._jdf.queryExecution().analyzed().expressions().head().child().sql()
            spark.sql(f"{make} {name}({', '.join(f'{a} {k}' for a, k in args)}) RETURNS {out.schema['r'].dataType.simpleString()} RETURN {body}")
        elif name in _HEADS:
            kind, body = BODIES[_HEADS[name]]
            spark.sql(f"{make} {_HEADS[name]} RETURNS {kind} RETURN {body}")
        elif name == "generate_uuid":
            spark.sql(f"{make} generate_uuid() RETURNS string NOT DETERMINISTIC RETURN uuid()")
        else:
            text.register(spark)
        known.add(name)
