"""Queries written in the dialect, over the tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import register
from .dialect import Session
from .registry import query


class Views:
    """A session's temp views in the place of a database: nothing can be changed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.settings = spark, {}

    def has(self, name: str) -> bool:
        return False

    def views(self) -> dict[str, str]:
        return {}

    def log(self, sql: str, parameters: str = "") -> None:
        """Queries over views leave no trace."""


def ask(spark: SparkSession, d: str, tables: str, sql: str, texts: tuple[str, ...] = (), args: list | None = None, **settings: str) -> DataFrame:
    register(spark, d, tables.split())
    session = Session(Views(spark), texts)
    session.db.settings |= settings
    return session.run(sql, args)


@query("""SELECT p_partkey, p_size & 12 AS b_and, xor(p_size, 5) AS b_xor, bit_count(p_size::INT)::INT AS b_count, CASE WHEN p_size = 0 THEN -1 ELSE floor(log2(p_size))::INT END AS b_max,
p_size << 3 AS b_left, p_size >> 1 AS b_right, (p_size >> 2) & 1 AS b_set, ((p_size << 5) & 1023)::INT AS b_turn FROM part""")
def sql_bits(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "part", """SELECT p_partkey, bitand(p_size, 12) AS b_and, bitxor(p_size, 5) AS b_xor, bitcount(p_size) AS b_count, bitmax(p_size) AS b_max,
bitshiftleft(p_size, 3) AS b_left, bitshiftleft(p_size, -1) AS b_right, bitisset(p_size, 2) AS b_set, bitand(bitrotateleft(p_size, 5), 1023) AS b_turn FROM part""")


@query("""SELECT o_orderkey, dayname(o_orderdate) AS d_name, monthname(o_orderdate) AS m_name, ((dayofyear(o_orderdate) + 7 - (dayofweek(o_orderdate) + 1)) // 7)::INT AS d_week,
date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS d_seq, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS m_seq FROM orders WHERE year(o_orderdate) = 1996""")
def sql_dates(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "orders", """SELECT o_orderkey, dayname(o_orderdate) AS d_name, monthname(o_orderdate) AS m_name, week(o_orderdate) AS d_week,
dayseq(o_orderdate) AS d_seq, monthseq(o_orderdate) AS m_seq FROM orders WHERE year(o_orderdate) = ?""", args=[1996])  # fmt: skip


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS moved, '' AS gone, '[' || json_extract_string(props, '$.k') || ']' AS listed FROM events""")
def sql_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents changed in a query, and read again."""
    return ask(spark, d, "events", """SELECT event_id, props.$.k AS k, json_value(json_modify(props, '$.z', json_value(props, '$.k')), '$.z') AS moved,
json_value(json_merge_patch(props, '{"k":null}'), '$.k') AS gone, json_query(json_modify('{"l":[]}', 'append $.l', json_value(props, '$.k')), '$.l') AS listed FROM events""")


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 4) AS dot, round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]) ** 2, 4) AS l2sq FROM embeddings""")
def sql_vectors(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "embeddings", "SELECT vec_id, round(vecdist(embedding, reverse(embedding)), 4) AS dot, round(vecdist(embedding, reverse(embedding), 'l2sq'), 4) AS l2sq FROM embeddings")


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}'']+')"
_FLAT = "concat(' ', array_to_string(" + _WORDS + ", ' '), ' ')"


@query(f"""SELECT doc_id FROM documents WHERE contains({_FLAT.format('text')}, ' license ') AND NOT contains({_FLAT.format('text')}, ' apache ')
AND contains({_FLAT.format("concat_ws(' ', lang, text)")}, ' en ')""")
def sql_like(spark: SparkSession, d: str) -> DataFrame:
    """Text search in SQL: words, an exclusion, and a virtual field."""
    return ask(spark, d, "documents", r"SELECT doc_id FROM documents WHERE text LIKE 'license -apache' AND lang\text LIKE 'en'", ("text",))


@query(f"""SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND contains({_FLAT.format('text')}, ' und ')::INT + contains({_FLAT.format('text')}, ' der ')::INT + contains({_FLAT.format('text')}, ' license ')::INT >= 2 GROUP BY lang""")
def sql_like_sets(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "documents", "SELECT lang, count(*) AS n FROM documents WHERE text LIKE 'und der license @1' GROUP BY lang", ("text",))
