"""Queries over scalar, list, JSON, vector, geo and address functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, dates, geo, jsons, lists, net, numbers, text, vectors
from ..session import load
from .registry import query


@query("""SELECT event_id, dayname(ts) AS day_name, monthname(ts) AS month_name, month(ts)::INT AS month, day(ts)::INT AS day_of_month, dayofyear(ts)::INT AS day_of_year,
year(ts)::INT AS year, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, (dayofweek(ts) + 1)::INT AS day_of_week, quarter(ts)::INT AS quarter,
strftime(ts, '%U')::INT AS week FROM events""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return load(spark, d, "events").select(
        "event_id", dates.day_name(ts).alias("day_name"), dates.month_name(ts).alias("month_name"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day_of_month"),
        F.dayofyear(ts).alias("day_of_year"), F.year(ts).alias("year"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"),
        F.dayofweek(ts).alias("day_of_week"), F.quarter(ts).alias("quarter"), dates.week(ts).alias("week"),
    )


@query("""SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS month_seq, floor(date_diff('day', DATE '1970-01-04', o_orderdate::DATE) / 7.0)::INT AS week_seq,
date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS day_seq FROM orders""")
def date_seq(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", dates.month_seq(t).alias("month_seq"), dates.week_seq(t).alias("week_seq"), dates.day_seq(t).alias("day_seq"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT + 90 AS later, (epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01'))::BIGINT AS since FROM orders")
def date_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    start = F.lit("1992-01-01").cast("timestamp")
    return load(spark, d, "orders").select("o_orderkey", F.unix_timestamp(dates.add_seconds(t, F.lit(90))).alias("later"), dates.seconds_between(t, start).alias("since"))


@query("""SELECT o_orderkey, o_orderkey & o_custkey AS b_and, o_orderkey | o_custkey AS b_or, xor(o_orderkey, o_custkey) AS b_xor, 4294967295 - o_orderkey AS b_not, bit_count(o_orderkey)::INT AS b_count,
((o_orderkey >> 3) & 1)::INT AS is_set, (o_orderkey | 32) AS with_5, (o_orderkey & (4294967295 - 32)) AS without_5, ((o_orderkey << 5) & 4294967295) AS left_5, (o_orderkey >> 5) AS right_5,
(((o_orderkey << 7) | (o_orderkey >> 25)) & 4294967295) AS rotated FROM orders""")
def bit_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b, first = bits.as_words(F.col("o_orderkey")), bits.as_words(F.col("o_custkey")), lambda c: F.get(c, F.lit(0))
    five = F.lit(5)
    return load(spark, d, "orders").select(
        "o_orderkey", first(bits.bit_and(a, b)).alias("b_and"), first(bits.bit_or(a, b)).alias("b_or"), first(bits.bit_xor(a, b)).alias("b_xor"), first(bits.bit_not(a)).alias("b_not"),
        bits.bit_count(a).alias("b_count"), bits.bit_is_set(a, F.lit(3)).alias("is_set"), first(bits.bit_set(a, five)).alias("with_5"), first(bits.bit_clear(a, five)).alias("without_5"),
        first(bits.bit_shift_left(a, five)).alias("left_5"), first(bits.bit_shift_right(a, five)).alias("right_5"), first(bits.bit_rotate_left(a, F.lit(7))).alias("rotated"),
    )


@query("""SELECT p_partkey, array_to_string(l, ',') AS set_bits, l[1]::INT AS low, l[-1]::INT AS high FROM (SELECT p_partkey, CASE WHEN p_partkey = 0 THEN [-1] ELSE list_filter(range(32), lambda b: (p_partkey >> b) & 1 = 1) END AS l FROM part)""")
def bit_list(spark: SparkSession, d: str) -> DataFrame:
    a = bits.as_words(F.col("p_partkey"))
    return load(spark, d, "part").select("p_partkey", F.array_join(bits.bit_list(a).cast("array<string>"), ",").alias("set_bits"), bits.bit_min(a).alias("low"), bits.bit_max(a).alias("high"))


@query("""SELECT p_partkey, round(sqrt(p_retailprice), 6) AS m_sqrt, round(ln(p_retailprice), 6) AS m_log, round(log10(p_retailprice), 6) AS m_log10, round(sin(p_size), 6) AS m_sin,
round(cos(p_size), 6) AS m_cos, round(tan(p_size), 6) AS m_tan, round(atan2(p_size, 3), 6) AS m_atan2, floor(p_retailprice) AS m_floor, ceil(p_retailprice) AS m_ceil,
round(pow(p_size, 2), 6) AS m_pow, round(fmod(p_retailprice, 7), 6) AS m_fmod, 0 AS m_nan FROM part""")
def math_fns(spark: SparkSession, d: str) -> DataFrame:
    price, size, r = F.col("p_retailprice"), F.col("p_size").cast("double"), lambda c: F.round(c, 6)
    one = numbers.one
    return load(spark, d, "part").select(
        "p_partkey", r(one("sqrt", price)).alias("m_sqrt"), r(one("log", price)).alias("m_log"), r(one("log10", price)).alias("m_log10"), r(one("sin", size)).alias("m_sin"),
        r(one("cos", size)).alias("m_cos"), r(one("tan", size)).alias("m_tan"), r(numbers.atan2(size, F.lit(3.0))).alias("m_atan2"), one("floor", price).alias("m_floor"),
        one("ceil", price).alias("m_ceil"), r(numbers.power(size, F.lit(2.0))).alias("m_pow"), r(numbers.fmod(price, F.lit(7))).alias("m_fmod"), numbers.is_nan(price).alias("m_nan"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) AS kind, CASE WHEN json_valid(props) THEN 1 ELSE 0 END AS valid FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select("event_id", jsons.json_value(p, "$.k").alias("k"), jsons.json_type(p).alias("kind"), jsons.is_json(p).alias("valid"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k')::INT < 50 GROUP BY 1")
def json_group(spark: SparkSession, d: str) -> DataFrame:
    k = jsons.json_path(F.col("props"), "$.k")
    return load(spark, d, "events").where(k.cast("int") < 50).groupBy(k.alias("k")).agg(F.count("*").alias("n"))


_ALL = "regexp_extract_all(lower(text), '[a-z]+')"


def _words(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return load(spark, d, "documents").select("doc_id", words.alias("x"))


@query(f"SELECT doc_id FROM documents WHERE list_contains({_ALL}, 'that')")
def list_member(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).where(lists.member(F.lit("that"), F.col("x"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all(['the', 'of', 'and', 'a', 'in', 'is', 'that', 'to', 'on', 'or'], {_ALL})")
def list_subset(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).where(lists.subset(F.col("x"), "the of and a in is that to on or".split())).select("doc_id")


@query(f"SELECT w, count(*) AS n FROM (SELECT unnest({_ALL}) AS w FROM documents) GROUP BY w")
def list_explode_group(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select(F.explode("x").alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_ALL}, lambda w: w LIKE 'th%ing')) > 0")
def list_matches(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).where(lists.matches(F.col("x"), "th%ing", is_list=True)).select("doc_id")


@query("SELECT vec_id, round(embedding[1] + embedding[2], 5) AS two, 0.0 AS padded FROM embeddings")
def array_fixed(spark: SparkSession, d: str) -> DataFrame:
    e = lists.fixed(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 2), 4, F.lit(0.0))
    two = F.round(F.element_at("embedding", 1) + F.element_at("embedding", 2), 5)
    return load(spark, d, "embeddings").select("vec_id", two.alias("two"), F.element_at(e, 3).alias("padded"))


@query("SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS exact, CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END AS nocase FROM part")
def str_compare(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return load(spark, d, "part").select("p_partkey", text.string_compare(a, b).alias("exact"), text.string_compare(a, b, "nocase").alias("nocase"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path,
nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = text.url_parts(F.col("url"))
    return load(spark, d, "pages").select("page_id", *[p[k].alias(k) for k in ("protocol", "host", "path", "query")])


@query("SELECT p_partkey, p_name LIKE '%a%e%' AS wild, replace(replace(p_name, 'a', '4'), 'e', '3') AS swapped FROM part")
def replace_wildcard(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", text.wildcard(n, "*a*e*", ignore_case=False).alias("wild"), text.replace_pairs(n, [("a", "4"), ("e", "3")]).alias("swapped"))


_IP = "concat('10.', (c_custkey // 256) % 256, '.', c_custkey % 256, '.7')"


@query(f"SELECT c_custkey, 167772160 + ((c_custkey // 256) % 256) * 65536 + (c_custkey % 256) * 256 + 7 AS number, {_IP} AS back, concat('10.', (c_custkey // 256) % 256, '.0.0') AS net, 'A' AS kind, CASE WHEN (c_custkey // 256) % 256 = 2 THEN 1 ELSE 0 END AS inside FROM customer")
def inet_ops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = F.concat(F.lit("10."), F.pmod(F.floor(k / 256), F.lit(256)).cast("string"), F.lit("."), F.pmod(k, F.lit(256)).cast("string"), F.lit(".7"))
    wide = F.concat(ip, F.lit("/16"))
    return load(spark, d, "customer").select(
        "c_custkey", net.inet_to_int(ip).alias("number"), net.int_to_inet(net.inet_to_int(ip)).alias("back"), net.network(wide).alias("net"), net.address_class(ip).alias("kind"),
        net.contains(F.lit("10.2.0.0/16"), ip).alias("inside"),
    )


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v), 6) AS dot FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10""")
def vec_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(e, q, 10, "embedding", "vec_id").select("vec_id", F.round("distance", 6).alias("dot"))


@query("""SELECT query_id, place, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS place
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE place <= 5""")
def vec_nearest_each(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.nearest_each(e, q, 5, "embedding", "vec_id", "cosine").select("query_id", "place", "vec_id")


@query("SELECT vec_id, round(list_distance(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS zero, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm2 FROM embeddings")
def vec_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", F.round(vectors.distance(v, v, "l2sq"), 6).alias("zero"), F.round(vectors.distance(v, v), 4).alias("norm2"))


@query("SELECT c_custkey, c_custkey % 180 - 90 + 0.25 AS lat, (c_custkey * 7) % 360 - 180 + 0.25 AS lon FROM customer WHERE c_custkey % 180 - 90 + 0.25 BETWEEN 10 AND 40 AND (c_custkey * 7) % 360 - 180 + 0.25 BETWEEN -20 AND 60")
def geo_box(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select("c_custkey", (k % 180 - 90 + 0.25).alias("lat"), ((k * 7) % 360 - 180 + 0.25).alias("lon"))
    box = [F.lit(x).cast("double") for x in (10, -20, 40, 60)]
    out = c.where(geo.in_box(F.col("lat").cast("double"), F.col("lon").cast("double"), *box))
    return out.select("c_custkey", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


@query()
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A sketch for each event type, merged again over all types."""
    per = load(spark, d, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("s"))
    each = per.select("event_type", F.hll_sketch_estimate("s").alias("n_users"))
    return each.union(per.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n_users")).select(F.lit("all"), "n_users"))


@query()
def numeric_phrases(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(text.numeric_match(F.col("text"), ">1000")).select("doc_id")


@query()
def json_updates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select(
        "event_id", jsons.json_merge_patch(p, F.lit('{"k":null,"seen":true}')).alias("patched"), jsons.json_merge_preserve(p, F.lit('{"k":0}')).alias("kept"),
        jsons.json_modify(p, "$.tag", F.lit("x")).alias("tagged"),
    )


@query("""WITH p AS (SELECT c_custkey, c_custkey % 180 - 90 + 0.25 AS lat, (c_custkey * 7) % 360 - 180 + 0.25 AS lon FROM customer),
r AS (SELECT n_nationkey, n_nationkey * 7 - 90 AS south, n_nationkey * 13 - 180 AS west, n_nationkey * 7 - 70 AS north, n_nationkey * 13 - 150 AS east FROM nation)
SELECT c_custkey, n_nationkey FROM p JOIN r ON lat BETWEEN south AND north AND lon BETWEEN west AND east""")
def geo_region_join(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    p = load(spark, d, "customer").select("c_custkey", (k % 180 - 90 + 0.25).alias("lat"), ((k * 7) % 360 - 180 + 0.25).alias("lon"))
    r = load(spark, d, "nation").select("n_nationkey", (n * 7 - 90).alias("south"), (n * 13 - 180).alias("west"), (n * 7 - 70).alias("north"), (n * 13 - 150).alias("east"))
    return geo.region_join(p, r).select("c_custkey", "n_nationkey")


@query("SELECT p_partkey, easter::DATE AS easter, julian::INT AS julian FROM (SELECT p_partkey, DATE '2024-03-31' AS easter, 2440588 + date_diff('day', DATE '1970-01-01', DATE '2024-03-31') AS julian FROM part)")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    day = dates.easter(F.lit(2024))
    return load(spark, d, "part").select("p_partkey", day.alias("easter"), dates.julian_day(day).alias("julian"))


def placed(df: DataFrame, key: Column, id_col: str, ranges: int = 64) -> DataFrame:
    """df with `place`, the number of each row by key, nulls last, and then id_col, over the whole table.

    Rows are dealt to ranges of keys, whose borders come from the rows with the least hashes of ids.
    A row's place is its number within its range plus the rows of the ranges before.
    """
    at = F.struct(key.isNull().alias("none"), key.alias("key"), F.col(id_col).alias("id"))
    keyed = df.withColumn("_at", at)
    some = keyed.select("_at").orderBy(F.xxhash64("_at.id"), "_at").limit(100 * ranges).agg(F.array_sort(F.collect_list("_at")).alias("some"))
    borders = F.broadcast(some.select(F.filter("some", lambda x, i: i % 100 == 99).alias("_borders")))
    dealt = keyed.crossJoin(borders).withColumn("_range", F.size(F.filter("_borders", lambda x: x <= F.col("_at")))).drop("_borders")
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")  # one row for each range
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_at"))
    return dealt.withColumn("_within", within).join(F.broadcast(counts), "_range").select(*df.columns, (F.col("_before") + F.col("_within")).alias("place"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part ORDER BY 3 LIMIT 50")
def collated_order(spark: SparkSession, d: str) -> DataFrame:
    """Order without regard to case: the whole table is numbered, the rows of the SQL are returned."""
    part = load(spark, d, "part").select("p_partkey", "p_name")
    return placed(part, F.collate("p_name", "UTF8_LCASE"), "p_partkey").where("place <= 50")


@query()
def generated_values(spark: SparkSession, d: str) -> DataFrame:
    """A unique id, a bounded random number and the hash of a name for each nation."""
    return load(spark, d, "nation").select("n_nationkey", F.uuid().alias("id"), numbers.random_between(1, 6, seed=1).alias("die"), text.hash64(F.col("n_name")).alias("hash"))


@query()
def approximate_match(spark: SparkSession, d: str) -> DataFrame:
    close = text.approximate(F.col("p_type"), "standrad", 80)
    return load(spark, d, "part").select("p_partkey", close.alias("percent")).where("percent is not null")


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN false ELSE true END AS allowed FROM pages")
def robots(spark: SparkSession, d: str) -> DataFrame:
    rules = F.lit("User-agent: *\nDisallow: /en/\n")
    return load(spark, d, "pages").select("page_id", text.robots_allowed("bot", rules, F.col("url")).alias("allowed"))
