"""Quality rules as a short-circuit cascade of SQL expressions.

Base figures are computed for every whole text. The rules beyond the base decide in a CASE whose
branches stand in the order of rejection per cost, both estimated on a bounded sample; a text that
a rule rejects is not seen by later rules. The verdict is the same in any order.

A rule's cost is what it reads of a row: a code point for each one that its patterns pass over, as
the sample has them, and STEP for each operation on figures. Unlike a clock this gives the same order
on every run. Rejection is counted among the rows that no rule before it rejects, so of two rules that
reject the same texts only one stands early. Ties go to the name.

Nulls and texts without words have no words and fail the base. No row is dropped, repeated rows
are judged alike, and columns other than id and text are not read. Very long texts are read whole and
weigh in the costs by their length. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Staging

#: Bound of the sample on which costs and rejection rates of rules are estimated.
SAMPLE_ROWS = 400
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 10, 20, 5
#: Cost of an operation on figures, in code points that a pattern passes over.
STEP = 0.5


@dataclass(frozen=True)
class Rule:
    """fails: the rejection, on the columns of base_figures; passes: patterns run over the whole text;
    steps: operations on figures."""

    fails: Column
    passes: int = 0
    steps: int = 3


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def _sorted_windows(keys: Column) -> Column:
    """(key, position) in order, only where some key occurs twice; else null."""
    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), pairs)


def _repeat_words(pairs: Column) -> Column:
    """Words in windows whose key occurs twice or more. pairs must be a column, not an expression:
    what a lambda holds is computed again for each element."""
    same = F.filter(
        pairs,
        lambda p, j: ((j > 0) & (F.get(pairs, j - 1)["k"] == p["k"])) | F.coalesce(F.get(pairs, j + 1)["k"] == p["k"], F.lit(False)),
    )
    at = F.sort_array(F.transform(same, lambda p: p["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW_WORDS).cast("int").alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW_WORDS), i - a["last"])).cast("long").alias("n"), i.alias("last"))
    return F.coalesce(F.aggregate(at, zero, step, lambda a: a["n"]), F.lit(0).cast("long"))


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the base figures; arrays of words and lines are dropped again."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text")))
    last = F.size("w") - WINDOW_WORDS
    hashes = F.transform(F.col("w"), lambda x: F.xxhash64(x))
    d = d.withColumn("h", hashes).withColumn(
        "keys",
        F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(WINDOW_WORDS)]))
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("pairs", _sorted_windows(F.col("keys")))
    return d.select(
        "doc_id", "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("pairs")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    ).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def rules() -> dict[str, Rule]:
    """The further rules by name."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    return {
        "word_length": Rule((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n), steps=6),
        "symbols": Rule(10 * F.col("n_symbols") > n),
        "dup_lines": Rule(10 * F.col("n_dup_lines") > 3 * lines, steps=4),
        "letters": Rule(2 * letters < F.col("word_chars"), passes=1),
        "bullets": Rule(10 * F.regexp_count("text", F.lit(r"(?md)^[\x20\x09]*[-*•]")) > 9 * lines, passes=1, steps=4),
        "ellipses": Rule(10 * F.regexp_count("text", F.lit(r"(?md)(?:\.\.\.|…)[\x20\x09]*$")) > 3 * lines, passes=1, steps=4),
    }


def order_rules(sample: DataFrame, found: dict[str, Rule]) -> list[str]:
    """Names of rules by rejection per cost on the base figures of a sample."""
    names = sorted(found)
    marks = [F.coalesce(found[name].fails, F.lit(False)).cast("int").alias(f"r{i}") for i, name in enumerate(names)]
    rows = sample.where(~F.col("base_failed")).select(*marks, F.length("text").alias("size")).collect()  # at most as many as the sample has
    order, left = [], names
    while left:
        size = sum(r["size"] for r in rows) / max(len(rows), 1)

        def gain(name: str, rows=rows, size=size) -> float:
            cost = found[name].passes * size + STEP * found[name].steps
            return (sum(r[f"r{names.index(name)}"] for r in rows) + 0.5) / (len(rows) + 1) / cost

        best = max(left, key=gain)
        order.append(best)
        left = [name for name in left if name != best]
        rows = [r for r in rows if not r[f"r{names.index(best)}"]]
    return order


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base figures, base_failed, kept and the first failed rule of each document."""
    figures = base_figures(docs, id_col, text_col)
    found = rules()
    # the rows with the least hash: the same sample on every run; the first pass moves hashes only
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col, id_col).alias("h"))
    last = lean.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    cut = lean.where(F.col("h") <= F.lit(last)).drop("h").limit(sample_rows)
    order = order_rules(Staging(docs.sparkSession).put(base_figures(cut)), found)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        verdict = verdict.when(found[name].fails, F.lit(name))
    out = figures.withColumn("failed_rule", verdict)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept")
    )
