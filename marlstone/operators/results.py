"""What a client asks about a result: its shape as text, rows for the eye, bounds of its row count, a page of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CountBounds:
    """least <= rows <= most; most is None where the plan has no bound."""

    least: int
    most: int | None

    @property
    def exact(self) -> bool:
        return self.least == self.most


def count_bounds(df: DataFrame) -> CountBounds:
    """Bounds of the row count from the optimised plan, without running it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    most = plan.maxRows()
    known = plan.stats().rowCount()
    most = int(most.get()) if most.isDefined() else None
    whole = known.isDefined() and plan.getClass().getSimpleName() in ("LocalRelation", "OneRowRelation", "Range")
    rows = int(str(known.get())) if whole else None
    return CountBounds(rows or 0, most if rows is None else rows)


def schema_text(df: DataFrame, kind: str = "T") -> str:
    """Kind and number of fields, then name, type, count and whether null is refused, a line for each field."""
    lines = [f"{kind} {len(df.schema.fields)}"]
    for f in df.schema.fields:
        name = f.dataType.simpleString()
        inner = name[6:-1] if name.startswith("array<") else name
        lines.append(f"{f.name} {inner} {'*' if inner != name else 1} {'notnull' if not f.nullable else 'null'}")
    return "\n".join(lines)


def pretty(df: DataFrame, rows: int = 20, widest: int = 40) -> str:
    """The first rows as a table of fixed columns under a ruled head."""

    def shown(v: object) -> str:
        text = "" if v is None else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
        text = text.replace("\n", " ")
        return text if len(text) <= widest else text[: widest - 1] + "…"

    found = [[shown(v) for v in r] for r in df.limit(rows).collect()]
    wide = [max(len(c), *(len(r[i]) for r in found), 1) if found else len(c) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)).rstrip()
    return "\n".join([line([c.center(w) for c, w in zip(df.columns, wide, strict=True)]), "+".join("-" * (w + 1) for w in wide), *map(line, found)])


def fetch(df: DataFrame, order: list[str], skip: int = 0, most: int = 10) -> tuple[list[dict], dict[str, int | None]]:
    """A page of rows in a given order, and what is known of the count: skipped, fetched, bounds."""
    rows = [r.asDict() for r in df.orderBy(*order).offset(skip).limit(most).collect()]
    bounds = count_bounds(df)
    return rows, {"skipped": skip, "fetched": len(rows), "least": max(bounds.least, skip + len(rows) if rows else 0), "most": bounds.most}
