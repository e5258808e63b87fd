"""Secret scans over an incremental ledger of blobs.

A blob is one text, named by its SHA-256, however many paths or versions hold it. The ledger has
the spans of each (blob, rule version) that has been scanned. A scan takes the blobs of all
versions, leaves out the pairs the ledger has, scans the rest once, appends them, and joins spans back
to every path. Only DataFrame functions run on rows. `Ledger` keeps the rows in a folder, one part for
each scan, so that a later scan of the same or of further versions only reads what is new.

A null text is an empty blob without spans. Repeated paths keep their rows. Spans are counted in
code points, ends exclusive; spans of two kinds may overlap and are both kept, by start and then kind.
Texts of any length are scanned whole. An empty table gives no rows and adds nothing to the ledger.
Columns other than id and text, whatever their names, are not read; ids may be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging


@dataclass(frozen=True)
class Rule:
    """group_len: least length of group 2 (of the whole match where there is no group 2)."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds are listed; the last adds to them.
RULES = (
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
#: The rules of redaction: as above, but a key goes up to its END line or, without one, with the base64 lines that follow.
HIDING = (
    *RULES[:-1],
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,}+(?=\s|\z)(?:\s+[A-Za-z0-9+/=]{1,76}+(?=\s*\z))?)*+)", 0, 1),
)
SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def _lengthened(rule: Rule) -> str:
    """A pattern whose matches are those of the rule that are long enough, where that is the same.

    A greedy run of one class is found whole or not at all, so its least length can stand in the
    pattern; a short match that takes text from a later one can't be left out so, hence `assign`
    keeps its pattern.
    """
    return {"hex": "[0-9a-f]{16,}", "access": "AKIA[A-Z0-9]{14,}"}.get(rule.kind, rule.pattern)


def spans_of(text: Column, rule: Rule, kind_no: int) -> Column:
    """Array of spans of one rule: pieces between matches give the offsets of matches."""
    pattern = _lengthened(rule)
    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # one array, the input of the aggregate, so that each pattern runs over the text once for all matches
    parts = F.arrays_zip(every(0), every(rule.group), F.split(text, pattern, -1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["2"])
        end = start + F.length(x["0"])
        one = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"))
        out = F.when(F.length(x["1"]) >= rule.least, F.concat(a["out"], F.array(one))).otherwise(a["out"])
        return F.struct(F.coalesce(end, a["at"]).alias("at"), out.alias("out"))  # the last gap has no match

    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): each distinct blob once, with the rules not yet run on it.

    Copies are reduced to one by a partial aggregate before the shuffle.
    """
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    want = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", want)
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    left = blobs.join(done, "blob", "left")
    todo = F.array_except(want, F.coalesce("done", F.array().cast("array<string>")))
    return left.select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the spans of the rules in `todo`, by start and kind."""
    each = [
        F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), spans_of(F.col("text"), r, i)).otherwise(F.array().cast(SPAN))
        for i, r in enumerate(rules)
    ]
    return blobs.select("blob", "todo", F.array_sort(F.concat(*each)).alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Rows to append to the ledger: (blob, kind, version, spans) for each unseen pair."""
    versions = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = scan(unseen(versions, ledger, rules), rules)
    of = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("no")) for i, r in enumerate(rules)])
    one = found.select("blob", "todo", "spans", F.explode(of).alias("r")).where(F.array_contains("todo", F.concat_ws(":", "r.kind", "r.version")))
    return one.select("blob", "r.kind", "r.version", F.filter("spans", lambda s: s["kind_no"] == F.col("r.no")).alias("spans"))


LEDGER = f"blob string, kind string, version int, spans {SPAN}"


class Ledger:
    """Rows of (blob, kind, version, spans) in a folder on any store that Spark can read and write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame | None:
        """All rows; None where nothing has been scanned."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
        """Scans what is unseen, appends it and returns all rows. A scan that fails appends nothing, and
        one that is done again finds its pairs in the ledger."""
        new = update_ledger(docs, self.rows(), rules, text_col)
        new.select("blob", "kind", F.col("version").cast("int"), F.col("spans").cast(SPAN)).write.mode("append").parquet(self.folder)
        return self.rows()


def _named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")


def _joined(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """docs with the columns _blob and _spans, found in the ledger by blob.

    Blobs without spans don't take part in the join. A blob that a third of all paths share is one
    large key of it, which the adaptive skew join splits.
    """
    no = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    hit = ledger.where(F.size("spans") > 0).withColumn("no", no[F.concat_ws(":", "kind", "version")]).where("no is not null")
    hit = hit.dropDuplicates(["blob", "no"]).select("blob", F.transform("spans", lambda s: F.struct(s["start"], F.col("no").alias("kind_no"), s["end"])).cast(SPAN).alias("spans"))
    hit = hit.groupBy(F.col("blob").alias("_of")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"))
    paths = docs.withColumn("_blob", blob_of(F.col(text_col))).join(hit, F.col("_blob") == F.col("_of"), "left").drop("_of")
    return paths.withColumn("_spans", F.coalesce("_spans", F.array().cast(SPAN)))


def _scanned(docs: DataFrame, ledger: Ledger | DataFrame | None, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """Ledger rows of all blobs of docs, after a scan of the unseen pairs. They are kept in the given
    ledger, without one in a ledger of this run; rows given as a table are not added to."""
    if isinstance(ledger, DataFrame):
        return ledger.unionByName(update_ledger(docs, ledger, rules, text_col))
    ledger = ledger or Ledger(docs.sparkSession, f"{Staging(docs.sparkSession).root}/ledger")
    return ledger.scan(docs, rules, text_col)


def findings(docs: DataFrame, ledger: Ledger | DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans array) for every path. Unseen pairs are scanned into the ledger first."""
    rows = _scanned(docs, ledger, rules, text_col)
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _joined(lean, rows, rules, "text").select("doc_id", F.col("_blob").alias("blob"), F.col("_spans").alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """doc_id, counts, digest of the base spans, and all spans as text."""
    n = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long")
    basic = F.filter("spans", lambda s: s["kind_no"] < base)
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_named(basic, rules), 256).alias("base_sha256"), _named(F.col("spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, ledger: Ledger | DataFrame | None = None, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = HIDING) -> DataFrame:
    """docs with secrets replaced by a mark; other columns, and texts without secrets, stay.

    Spans come from the ledger by blob, so equal texts are scanned once. Overlapping spans give one
    mark. Null texts stay null.
    """
    rows = _scanned(docs, ledger, rules, text_col)
    found, text = _joined(docs, rows, rules, text_col), F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

    cleaned = F.aggregate("_spans", zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, cleaned).otherwise(text)).select(*docs.columns)
