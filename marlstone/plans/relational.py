"""Relational queries over the tables, as DataFrame plans, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load
from .registry import query


@query("""SELECT n_name, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue, count(*) AS n_lines
FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey
AND l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' GROUP BY n_name HAVING count(*) > 2 ORDER BY 2 DESC, 1 LIMIT 20""")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    dates = F.col("l_shipdate").between(F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    li = load(spark, d, "lineitem").where(dates)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    # decimals: sums of doubles would depend on the order of rows
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")
    out = j.groupBy("n_name").agg(revenue.alias("revenue"), F.count("*").alias("n_lines")).where("n_lines > 2")
    return out.orderBy(F.desc("revenue"), "n_name").limit(20)


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND NOT (l_discount > 0.05 OR l_returnflag = 'A')")
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("l_quantity").between(10, 12) & ~((F.col("l_discount") > 0.05) | (F.col("l_returnflag") == "A"))
    return load(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("double_quantity"))


@query("SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_retailprice < s_acctbal AND p_size = 1 AND s_acctbal > 9000")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").where("p_size = 1").select("p_partkey", "p_retailprice")
    s = load(spark, d, "supplier").where("s_acctbal > 9000").select("s_suppkey", "s_acctbal")
    return p.join(s, p.p_retailprice < s.s_acctbal).select("p_partkey", "s_suppkey")


@query("SELECT a.event_id AS purchase, count(b.event_id) AS n_before FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 1 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'view' GROUP BY a.event_id")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in the day before each purchase: joined by day bucket, then by time."""
    e = load(spark, d, "events")
    day = F.date_trunc("day", "ts")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("at"))
    a = a.withColumn("day", F.explode(F.array(F.date_trunc("day", "at"), F.date_trunc("day", F.col("at") - F.expr("interval 1 day")))))
    b = e.where("event_type = 'view'").select("user_id", "ts", day.alias("day"))
    near = (F.col("ts") < F.col("at")) & (F.col("ts") >= F.col("at") - F.expr("interval 1 day"))
    return a.join(b, ["user_id", "day"]).where(near).groupBy("purchase").agg(F.count("*").alias("n_before"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").join(li, "o_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_subquery(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    c = load(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > (SELECT 1.9 * avg(l_extendedprice) FROM lineitem)")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber FROM _lineitem WHERE l_extendedprice > (SELECT 1.9 * avg(l_extendedprice) FROM _lineitem)")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT 1.8 * avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)")
def correlated_avg(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    mean = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"))
    return li.join(mean, "l_partkey").where("l_quantity > 1.8 * mean").select("l_orderkey", "l_linenumber")


@query("SELECT x.n_name AS a, y.n_name AS b FROM nation x, nation y WHERE x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def self_join_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    x, y = n.alias("x"), n.alias("y")
    on = (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))
    return x.join(y, on).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))


@query("SELECT r_name, count(c_custkey) AS n_customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY r_name")
def outer_join(spark: SparkSession, d: str) -> DataFrame:
    r, n = load(spark, d, "region"), load(spark, d, "nation")
    c = load(spark, d, "customer").where("c_acctbal > 9500")
    j = r.join(n, r.r_regionkey == n.n_regionkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left")
    return j.groupBy("r_name").agg(F.count("c_custkey").alias("n_customers"))


@query("SELECT e.event_id, max(p.ts) AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY e.event_id")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Last click up to each purchase, by one window over both kinds."""
    e = load(spark, d, "events").where("event_type in ('purchase', 'click')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.withColumn("last_click", F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "last_click")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal")).union(s.select("s_nationkey", "s_acctbal"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    c, s, n = load(spark, d, "customer"), load(spark, d, "supplier"), load(spark, d, "nation").where("n_regionkey = 0")
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    return both.subtract(n.select("n_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_vals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT count(*) AS n, count(props) AS n_props, count(DISTINCT user_id) AS n_users FROM events")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").agg(F.count("*").alias("n"), F.count("props").alias("n_props"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_stats(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    figures = [F.count("*").alias("n"), F.round(F.sum(q), 2).alias("total"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.avg(q), 6).alias("mean")]
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(*figures)


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n, grouping_id(n_regionkey, c_mktsegment) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube_segments(spark: SparkSession, d: str) -> DataFrame:
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_topk(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 40")
def skip_max(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").offset(40).limit(10)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT n_name, n_regionkey, row_number() OVER (ORDER BY CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END ASC NULLS LAST, n_name) AS place FROM nation")
def null_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Nulls are greater than any value."""
    key = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey"))
    w = Window.orderBy(F.asc_nulls_last(key), "n_name")  # 25 rows
    return load(spark, d, "nation").select("n_name", "n_regionkey", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
def parameters(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "orders").createOrReplaceTempView("_orders")
    return spark.sql("SELECT o_orderkey, o_orderdate FROM _orders WHERE o_orderpriority = ? AND o_totalprice > ?", args=["1-URGENT", 300000])


@query("SELECT 1 + 2 AS three, 'x' AS letter")
def select_without_from(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select((F.lit(1) + 2).alias("three"), F.lit("x").alias("letter"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(n, s)")
def value_list(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
