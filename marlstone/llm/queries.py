"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import bpe, decontam, jaccard, langid, license_scan, quality, secret_scan, sharding, toxicity, url_filter


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.findings(load(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(load(spark, sf_dir, "documents"), k=3, percent=90)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(load(spark, sf_dir, "documents"), shards=40)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return license_scan.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_jaccard_join, op3_sharding, op4_decontamination, op5_url_filters, op6_quality_rules, op7_license_scans, op8_language_id, op9_bpe, op10_toxicity)}


def _spans_sql() -> str:
    each = []
    for i, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        each.append(
            f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS hits, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS grp, regexp_split_to_array(t, '{pattern}') AS gaps FROM d"
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(each)}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
p AS (SELECT doc_id, k, kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(hits[i]) AS n
FROM i WHERE length(grp[i]) >= least),
s AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, k) AS spans FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, root AS component_id, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sh) END AS class_id, coalesce(n_links, 0) AS n_links
FROM s JOIN c ON c.a = s.doc_id LEFT JOIN k ON k.a = s.doc_id"""

_QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM c, range(5) AS t(j) GROUP BY doc_id),
f AS (SELECT doc_id, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
coalesce(e.n, 0) AS n_repeat_words, greatest(len(lines), 1) AS n_lines FROM d LEFT JOIN e USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS n FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * n OR word_chars > 25 * n OR 10 * n_symbols > n OR 10 * n_dup_lines > 3 * n_lines
OR 2 * len(regexp_extract_all(t, '\p{{L}}')) < word_chars OR 10 * len(regexp_extract_all(t, '(?m)^[\x20\x09]*[-*•]')) > 9 * n_lines OR 10 * len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[\x20\x09]*$')) > 3 * n_lines) AS kept FROM b"""

#: The others train a model, permute by hashes, or need a tokenizer. They are tested against brute force (op3, op4, op7),
#: the tokenizers library (op9), the fitted model row by row (op5), or by held-out accuracy (op8, op10).
ORACLE: dict[str, str] = {"op1_secret_scans": _spans_sql(), "op2_jaccard_join": _JACCARD_SQL, "op6_quality_rules": _QUALITY_SQL}
