"""JSON text functions: validity, type, values, containers, changes and merges.

Paths are `$`, `.name`, `."name"`, `[n]` and `[*]`. Reading stays in SQL expressions; functions that
build documents are Arrow UDFs over whole batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r'\.([A-Za-z_][\w-]*)|\."([^"]*)"|\[(\d+)\]|\[(\*)\]')


def steps(path: str) -> list[str | int]:
    """Names and positions of a path; `*` stands for all elements."""
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path!r}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"not a path: {path!r}")
        name, quoted, index, every = m.groups()
        out.append(int(index) if index else every or (name if name is not None else quoted))
        at = m.end()
    return out


def _spark_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) or s == "*" else f"['{s}']" for s in steps(path))


def is_json(text: Column) -> Column:
    """1 for a valid document, scalars included, else 0."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull().cast("int"))


def json_type(text: Column, path: str = "$") -> Column:
    """OBJECT, ARRAY, INTEGER, DOUBLE, STRING, BOOLEAN or NULL; null where there is nothing."""
    v = F.try_parse_json(text)
    v = v if path == "$" else F.try_variant_get(v, _spark_path(path), "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "VOID", "NULL")
        .when(kind == "STRING", "STRING").when(kind == "BOOLEAN", "BOOLEAN").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "INTEGER")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "DOUBLE")
    )


def json_value(text: Column, path: str) -> Column:
    """A scalar as text, doubles with six decimals; empty for containers and null."""
    kind, raw = json_type(text, path), F.get_json_object(text, _spark_path(path))
    real = F.format_string("%.6f", raw.try_cast("double"))
    return F.when(kind.isin("OBJECT", "ARRAY", "NULL"), "").when(kind == "DOUBLE", real).otherwise(F.coalesce(raw, F.lit("")))


def json_query(text: Column, path: str) -> Column:
    """A container as compact text; empty for scalars and null."""
    kind = json_type(text, path)
    return F.when(kind.isin("OBJECT", "ARRAY"), F.get_json_object(text, _spark_path(path))).otherwise("")


def json_path(text: Column, path: str) -> Column:
    """A computed column: the value or container at a path as text, null where there is none."""
    return F.get_json_object(text, _spark_path(path))


def json_list(text: Column, path: str) -> Column:
    """The strings that a path with `[*]` reaches; an empty list where there are none."""
    base = path.removesuffix("[*]")
    found = F.from_json(F.get_json_object(text, _spark_path(base)) if base != "$" else text, "array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


def _dump(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def modify(document: object, path: str, value: object, append: bool = False) -> object:
    """Sets, or appends to the array at, a path; missing objects on the way are made."""
    way = steps(path)
    if not way:
        return [*document, value] if append and isinstance(document, list) else value
    here, rest = way[0], way[1:]
    tail = "$" + "".join(f"[{s}]" if isinstance(s, int) else f'."{s}"' for s in rest)
    if isinstance(here, int):
        items = list(document) if isinstance(document, list) else []
        if here >= len(items):
            return [*items, modify(None, tail, value, append)]
        items[here] = modify(items[here], tail, value, append)
        return items
    found = dict(document) if isinstance(document, dict) else {}
    found[here] = modify(found.get(here), tail, value, append)
    return found


def merge_patch(target: object, patch: object) -> object:
    """RFC 7386."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = merge_patch(out.get(name), value)
    return out


def merge_preserve(a: object, b: object) -> object:
    """Objects merge by name, all else joins into one array."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge_preserve(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(x for x in b if x not in a)]}
    return [*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])]


def _pairwise(f):
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            if x is None or y is None:
                return None
            try:
                return _dump(f(json.loads(x), json.loads(y)))
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def json_merge_patch(a: Column, b: Column) -> Column:
    return _pairwise(merge_patch)(a, b)


def json_merge_preserve(a: Column, b: Column) -> Column:
    return _pairwise(merge_preserve)(a, b)


def json_modify(text: Column, path: str, value: Column) -> Column:
    """path may begin with `append `; value is JSON, or else taken as a string."""
    append, where = path.startswith("append "), path.removeprefix("append ").strip()
    steps(where)

    @F.pandas_udf("string")
    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(t: str | None, v: str | None) -> str | None:
            try:
                document = json.loads(t)
            except (TypeError, ValueError):
                return None
            try:
                v = json.loads(v) if v is not None else None
            except ValueError:
                pass
            return _dump(modify(document, where, v, append))

        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    return run(text, value.cast("string"))


def json_format(text: Column, indent: int | None = None) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(json.loads(t), indent=indent, ensure_ascii=False) if indent else _dump(json.loads(t))
            except (TypeError, ValueError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)
