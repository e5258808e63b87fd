"""Full-text, page and stream-shaped queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as textfn
from ..operators import search
from ..session import load
from ..sources import pages
from .registry import query

_WORDS = "regexp_extract_all(lower(text), '[a-z'']+')"
_FLAT = f"concat(' ', array_to_string({_WORDS}, ' '), ' ')"


#: Words of ASCII letters, as the SQL here has them.
ASCII = search.Words(search.ASCII)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text")


def _found(docs: DataFrame, q: search.Query) -> DataFrame:
    """Keys of matching documents from the postings of the query's words."""
    return search.match_index(search.postings(docs, "doc_id", "text", ASCII, q), q, "doc_id", docs.where("text is not null"))


@query(f"SELECT w AS term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY w")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    per = search.postings(_docs(spark, d), "doc_id", "text", ASCII).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@query(f"SELECT doc_id FROM documents WHERE contains({_FLAT}, ' shan ') AND contains({_FLAT}, ' hath ')")
def text_match_all(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.where(search.match_scan(F.col("text"), search.parse("shan hath", words=ASCII))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({_FLAT}, ' shan ') AND contains({_FLAT}, ' hath ') AND NOT contains({_FLAT}, ' oration ')")
def text_match_index(spark: SparkSession, d: str) -> DataFrame:
    return _found(_docs(spark, d), search.parse("shan hath -oration", words=ASCII))


@query(f"SELECT doc_id FROM documents WHERE contains({_FLAT}, ' idiot ') OR contains({_FLAT}, ' scum ') OR contains({_FLAT}, ' licensed ')")
def text_match_any(spark: SparkSession, d: str) -> DataFrame:
    return _found(_docs(spark, d), search.parse("(idiot,scum,licensed)", words=ASCII))


@query(f"SELECT doc_id FROM documents WHERE contains({_FLAT}, ' idiot ')::INT + contains({_FLAT}, ' scum ')::INT + contains({_FLAT}, ' pathetic ')::INT >= 2")
def text_match_sets(spark: SparkSession, d: str) -> DataFrame:
    return _found(_docs(spark, d), search.parse("idiot scum pathetic @1", words=ASCII))


@query(f"SELECT doc_id FROM documents WHERE contains({_FLAT}, ' idiot ') OR contains({_FLAT}, ' moron ') OR contains({_FLAT}, ' all rights reserved ')")
def text_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return _found(_docs(spark, d), search.parse("~idiot", {"idiot": ["moron", "all rights reserved"]}, words=ASCII))


@query(f"SELECT doc_id FROM documents WHERE contains({_FLAT}, ' apache license version ')")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return _found(_docs(spark, d), search.parse("apache-license-version", words=ASCII))


@query(f"""WITH p AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM p WHERE term IN ('license', 'apache', 'shan') GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM p),
s AS (SELECT doc_id, sum(ln(1 + n_docs / df) * (1 + 0.5 * ln(1 + tf) + 0.5 / (1 + first))) + (count(*) - 1.0) / (1 + max(first) - min(first)) AS score FROM t JOIN f USING (term), n GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 20""")
def doc_freq_rank(spark: SparkSession, d: str) -> DataFrame:
    q = search.parse("license apache shan", words=ASCII)
    n = _docs(spark, d).where(F.col("text").rlike(f"(?i){search.ASCII}")).agg(F.count("*").alias("n_docs"))
    return search.ranked(search.postings(_docs(spark, d), "doc_id", "text", ASCII, q), q, "doc_id", 20, n_docs=n)


@query("SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i::INT, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY 1, 2")
def trigram_lang_profile(spark: SparkSession, d: str) -> DataFrame:
    return textfn.ngram_profile(load(spark, d, "documents"), "text", ["lang"])


@query()
def trigram_language(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    return textfn.profile_language(docs, "doc_id", "text", textfn.ngram_profile(docs, "text", ["lang"]))


@query()
def hit_spans(spark: SparkSession, d: str) -> DataFrame:
    q = search.parse("(license,licensed) reserved @0", words=ASCII)
    s = search.spans(F.col("text"), q)
    return _docs(spark, d).select("doc_id", s.alias("s")).where(F.size("s") > 0).select("doc_id", F.to_json("s").alias("spans"), F.size("s").alias("n_hits"))


@query(f"""WITH q AS (SELECT item_id, list_distinct({_WORDS}) AS ws FROM benchmark),
d AS (SELECT doc_id, list_distinct({_WORDS}) AS ws FROM documents) SELECT item_id, doc_id FROM q, d WHERE len(q.ws) > 0 AND list_has_all(d.ws, q.ws)""")
def text_join(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    return search.text_join(_docs(spark, d), "doc_id", "text", q, "item_id", "q", ASCII)


@query(f"""WITH v AS (SELECT w AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY w),
p AS (SELECT q.word, term, df, levenshtein(q.word, term) AS edits FROM v, (VALUES ('licensse'), ('versoin'), ('underr')) AS q(word)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, df DESC, term) AS n FROM p WHERE edits BETWEEN 1 AND 2)
SELECT word, term AS suggestion, edits::INT AS edits FROM r WHERE n = 1""")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = term_counts(spark, d).select("term", "df")
    words = spark.createDataFrame([("licensse",), ("versoin",), ("underr",)], "word string")
    return textfn.suggest(words, vocabulary)


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']')) AS n_links FROM pages")
def page_link_counts(spark: SparkSession, d: str) -> DataFrame:
    links = pages.links(F.col("html"))
    return load(spark, d, "pages").select("page_id", F.size(F.filter(links, lambda x: x["kind"] == "link")).cast("long").alias("n_links"))


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", pages.plain_text(F.col("html")).alias("body"))


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def conversation_roles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_users(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_id, seq FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)")
def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", F.row_number().over(w).alias("seq"))


@query(f"SELECT doc_id FROM documents WHERE contains(concat(' ', array_to_string(regexp_extract_all(lower(concat_ws(' ', lang, text)), '[a-z'']+'), ' '), ' '), ' fr licensed ') OR (lang = 'en' AND contains({_FLAT}, ' scum '))")
def virtual_field(spark: SparkSession, d: str) -> DataFrame:
    """Two columns searched as one text."""
    both = "concat_ws(' ', lang, text)"
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    hit = search.match_scan(both, search.parse('"fr licensed"', words=ASCII)) | ((F.col("lang") == "en") & search.match_scan(F.col("text"), search.parse("scum", words=ASCII)))
    return docs.where(hit).select("doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)
WHERE len(list_filter(range(1, len(ws) + 1), lambda i: list_contains(ws[i:i + 3], 'apache') AND list_contains(ws[i:i + 3], 'version'))) > 0""")
def text_within(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(search.match_scan(F.col("text"), search.parse("apache version w/4", words=ASCII))).select("doc_id")


_LETTERS = "regexp_extract_all(lower(text), '[\\p{L}'']+')"
_ALL = f"concat(' ', array_to_string({_LETTERS}, ' '), ' ')"


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT contains({_ALL}, ' license ') AND NOT contains({_ALL}, ' der ')")
def text_without(spark: SparkSession, d: str) -> DataFrame:
    """Exclusions alone, from an index over words of any script."""
    q = search.parse("-license -der")
    docs = _docs(spark, d)
    return search.match_index(search.postings(docs, "doc_id", "text", only=q), q, "doc_id", docs.where("text is not null"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, {_LETTERS} AS ws FROM documents)
WHERE len(list_filter(range(1, len(ws) + 1), lambda i: list_contains(ws[i:i + 5], 'años') OR (list_contains(ws[i:i + 5], 'license') AND list_contains(ws[i:i + 5], 'under')))) > 0""")
def text_near_words(spark: SparkSession, d: str) -> DataFrame:
    """Words within six of each other, from an index; the scan and the index must agree."""
    docs, q = _docs(spark, d), search.parse("license under w/6")
    found = search.match_index(search.postings(docs, "doc_id", "text", only=q), q, "doc_id")
    return found.union(docs.where(search.match_scan("text", search.parse("años"))).select("doc_id")).distinct()


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_LETTERS}, lambda w: starts_with(w, 'licen'))) > 0 AND len(list_filter({_LETTERS}, lambda w: ends_with(w, 'ción'))) = 0")
def text_wildcards(spark: SparkSession, d: str) -> DataFrame:
    docs, q = _docs(spark, d), search.parse("licen* -*ción")
    return search.match_index(search.postings(docs, "doc_id", "text", only=q), q, "doc_id")

