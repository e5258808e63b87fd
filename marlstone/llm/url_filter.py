"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

Training rows are the URLs that a rule decides; the bound TRAIN_ROWS takes those with the least
hash. Trees are fitted by Spark's own GBTClassifier and applied as one SQL expression of nested
CASE branches, so that scoring stays in generated code. Statistics of host suffixes are counts
over all pages; the share of blocked URLs of a suffix that a training row sees comes from the other
FOLDS - 1 folds, so no row sees its own label.

A null URL, or one without `://`, has an empty host and path, fits no rule and is scored like any
other. With no labelled URL, or labels of one kind only, the verdict is that kind, or `allow`. Equal
rows are judged alike; a score of one half blocks. URLs of any length are read whole. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, FOLDS = 15, 3, 5
#: Bound of the broadcast of suffix statistics; more suffixes are joined by a shuffle.
SENT_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a URL; both empty where there is no `://`."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / F.length(c) / n
    entropy = F.aggregate(
        F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))
    )
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    ratio = lambda c, p: count(c, p) / F.greatest(F.length(c), F.lit(1))
    return {
        "url_len": n.cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"), "labels": count(host, r"\."), "digit_ratio": ratio(u, "[0-9]"), "path_digits": count(path, "[0-9]"),
        "entropy": entropy, "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "hyphens": count(u, "-"),
        "symbols": count(u, "[%_~=@]"), "tls": u.startswith("https:").cast("double"), "anchor": count(u, "#"),
        "host_vowels": ratio(host, "[aeiou]"),
    }


def _tree(node, names: list[str]) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), names)).otherwise(
        _tree(node.rightChild(), names)
    )


def trees_score(model: GBTClassificationModel, names: list[str]) -> Column:
    """The model's chance of label 1 as an expression on columns."""
    margin = sum((w * _tree(t._call_java("rootNode"), names) for w, t in zip(model.treeWeights, model.trees, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def _with_suffixes(p: DataFrame) -> DataFrame:
    """Adds suffix_n and suffix_block: how many pages a suffix has, and the share of blocked ones among
    those that a rule decides, in the other folds for a row that a rule decides itself."""
    blocked, ruled = F.col("ruled") == "block", F.col("ruled").isNotNull()
    each = [F.array(*[F.count(F.when(c & (F.col("fold") == k), 1)) for k in range(FOLDS)]).alias(name) for name, c in (("b", blocked), ("r", ruled))]
    stats = p.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_n"), *each)
    if stats.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        stats = F.broadcast(stats)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - F.when(ruled, F.get(c, F.col("fold"))).otherwise(F.lit(0))
    share = (total(F.col("b")) + 1) / (total(F.col("r")) + 2)
    return p.join(stats, "suffix").withColumn("suffix_block", share).drop("b", "r")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each page; score is the trees' chance of block."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    p = p.withColumn("host", host).withColumn("path", path)
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", text).withColumn("ruled", verdict).withColumns(features(F.col("url"), F.col("host"), F.col("path")))
    p = p.withColumn("suffix", F.substring_index("host", ".", -2)).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    p = _with_suffixes(p)
    names = [*features(F.col("url"), F.col("host"), F.col("path")), "suffix_n", "suffix_block"]
    known = p.where("ruled is not null").select(*names, (F.col("ruled") == "block").cast("double").alias("label"), F.xxhash64("url", "page_id").alias("_o"))
    train = known.orderBy("_o").limit(TRAIN_ROWS).drop("_o").coalesce(2).cache()
    kinds = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    if len(kinds) < 2:
        score = F.lit(1.0 if 1.0 in kinds else 0.0)
    else:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, stepSize=0.3, maxBins=32).fit(VectorAssembler(inputCols=names, outputCol="features").transform(train))
        score = trees_score(model, names)
    train.unpersist()
    p = p.withColumn("score", score)
    return p.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
