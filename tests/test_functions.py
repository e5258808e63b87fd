import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import bits, dates, geo, jsons, lists, net, numbers, text, vectors
from marlstone.operators import search


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_bits_wrap_pad_and_rotate(spark):
    five = bits.as_words(F.lit(5))
    assert one(spark, bits.bit_list(five), bits.bit_size(five), bits.bit_count(bits.as_words(F.lit(-1)))) == ([0, 2], 32, 32)
    assert one(spark, F.size(bits.bit_set(five, F.lit(40))), bits.bit_shift_left(five, F.lit(33)), bits.bit_shift_left(five, F.lit(-1))) == (2, [0], [2])
    assert one(spark, bits.bit_rotate_left(bits.as_words(F.lit(-2147483648)), F.lit(1)), bits.bit_min(bits.as_words(F.lit(0)))) == ([1], -1)
    two = bits.as_words(F.array(F.lit(1), F.lit(2)), is_array=True)
    assert one(spark, bits.bit_or(two, five), bits.bit_and(five, two), bits.bit_is_set(two, F.lit(33))) == ([5, 2], [1, 0], 1)


def test_dates(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, dates.week(t("2023-01-01")), dates.week(t("2022-01-01")), dates.day_name(t("2023-01-01"))) == (1, 0, "Sunday")
    now = t("2024-03-05 10:00:00")
    got = one(spark, *[dates.parse(F.lit(x), now) for x in ("1/2/69", "1/2/70", "1/1/1950", "now+5", "today-1", "nonsense")])
    assert [g and g.isoformat() for g in got] == ["2069-01-02T00:00:00", "1970-01-02T00:00:00", "1950-01-01T00:00:00", "2024-03-05T10:00:05", "2024-03-04T23:59:59", None]
    assert one(spark, dates.easter(F.lit(2024)), dates.us_holidays(F.lit(2024))["thanksgiving"]) == (dt.date(2024, 3, 31), dt.date(2024, 11, 28))


def test_numbers(spark):
    assert one(spark, numbers.fmod(F.lit(-7.5), F.lit(2)), numbers.is_nan(F.lit(float("nan"))), numbers.one("ceil", F.lit(1.2))) == (-1.5, 1, 2.0)


def test_lists(spark):
    modes = [lists.to_list(F.lit("1,2,3,")), lists.to_list(F.lit("2")), lists.to_list(F.lit("4|5|")), lists.to_list(F.lit('["a"]'), "json")]
    assert one(spark, *modes) == (["1", "2", "3"], [], ["4", "5"], ["a"])
    assert one(spark, lists.to_text(F.array(F.lit("a"), F.lit("b"))), lists.to_text(F.array(F.lit("a,b"), F.lit("c")))) == ("a,b,", "a,b|c|")
    assert one(spark, lists.fixed(F.array(F.lit(1), F.lit(2), F.lit(3)), 4), lists.to_numbers(F.array(F.lit("7"), F.lit("x")), "int")) == ([1, 2, 3, 0], [7, 0])
    assert one(spark, lists.subset(F.array(F.lit("b")), ["b"]), lists.subset(F.array(F.lit("a"), F.lit("c")), ["a"])) == (True, False)
    with pytest.raises(lists.IllegalOperation):
        lists.literal_matches("b%", F.col("x"))


DOC = '{"items":[{"Num":1,"Text":"The Name","First":true},{"Num":2.0},null]}'


def test_json_reading(spark):
    d = F.lit(DOC)
    paths = ["$", "$.items", "$.items[0].Num", "$.items[1].Num", "$.items[0].Text", "$.items[0].First", "$.items[2]"]
    assert one(spark, *[jsons.json_type(d, p) for p in paths]) == ("OBJECT", "ARRAY", "INTEGER", "DOUBLE", "STRING", "BOOLEAN", "NULL")
    assert one(spark, *[jsons.json_value(d, p) for p in paths]) == ("", "", "1", "2.000000", "The Name", "true", "")
    assert json.loads(one(spark, jsons.json_query(d, "$.items[1]"))[0]) == {"Num": 2.0}
    assert one(spark, jsons.json_list(F.lit('{"s":["C#","SQL"]}'), "$.s[*]"), jsons.json_list(F.lit("{}"), "$.s[*]")) == (["C#", "SQL"], [])


@pytest.mark.parametrize(
    ("target", "patch", "result"),
    [
        ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'),
        ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'),
        ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
    ],
)
def test_merge_patch(target, patch, result):
    assert jsons.merge_patch(json.loads(target), json.loads(patch)) == json.loads(result)


def test_json_changes(spark):
    a = F.lit('{"foo":{"bar":[40,42]}}')
    got = one(spark, jsons.json_modify(a, "append $.foo.bar", F.lit("99")), jsons.json_modify(a, "$.foo.bar", F.lit("99")), jsons.json_merge_preserve(F.lit("[1]"), F.lit("2")))
    assert got == ('{"foo":{"bar":[40,42,99]}}', '{"foo":{"bar":99}}', "[1,2]")


def test_addresses(spark):
    a = F.lit("10.1.2.3/16")
    assert one(spark, net.network(a), net.host(a), net.broadcast(a), net.netmask(a), net.mask_length(F.lit("192.168.1.1"))) == ("10.1.0.0", "0.0.2.3", "10.1.255.255", "255.255.0.0", 24)
    assert one(spark, net.to_ipv6(F.lit("1.2.3.4")), net.address_family(F.lit("::1")), net.contains(a, F.lit("10.1.9.9")), net.inet_to_int(F.lit("999.1.1.1"))) == ("::ffff:1.2.3.4", 6, 1, None)


def test_text(spark):
    assert text.numbers_in("ten million people, 3,500 cats and twenty one") == [10_000_000, 3500, 21]
    assert one(spark, text.numeric_match(F.lit("about five thousand"), ">4000"), text.wildcard(F.lit("Hello"), "h?l*")) == (True, True)
    assert one(spark, text.approximate(F.lit("a misisipi river"), "mississippi", 60))[0] >= 60
    assert text.common_cut("Home | News | Story one", "Home | News | Story two") == "one"
    assert text.murmur64(b"") != text.murmur64(b"a")
    assert one(spark, text.stem(F.lit("powers")), text.fold(F.lit("Élan")), text.string_compare(F.lit("a"), F.lit("B"), "nocase")) == ("power", "elan", -1)
    assert one(spark, text.replace_pairs(F.lit("x1y"), [(r"\digit", "-")]))[0] == "x-y"


def test_geo_and_vectors(spark):
    code = geo.encode(F.lit(41.5), F.lit(-81.7))
    lat, lon = one(spark, *geo.decode(code))
    assert abs(lat - 41.5) < 1e-5 and abs(lon + 81.7) < 1e-5
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.distance(v(1, 2), v(3, 4)), vectors.distance(v(1, 2), v(3, 4), "l2sq"), vectors.distance(v(1), v(1, 2))) == (11.0, 8.0, None)
    assert one(spark, vectors.rigid_rmsd(v(0, 0, 0, 1, 0, 0, 0, 2, 0), v(0, 0, 0, 0, 1, 0, -2, 0, 0)))[0] < 1e-6


def test_search_index_equals_scan(spark):
    docs = spark.createDataFrame([(1, "An indexed.row is here"), (2, "row of liberty and power"), (3, None), (4, "the power struggle")], "doc_id long, text string")
    index = search.postings(docs, "doc_id", "text")
    for q in ("indexed-row", "power", "power -struggle", "(row,struggle)", "row liberty here @1"):
        query = search.parse(q)
        scan = {r[0] for r in docs.where(search.match_scan(F.col("text"), query)).collect()}
        assert {r[0] for r in search.match_index(index, query, "doc_id").collect()} == scan, q
    hits = docs.where("doc_id = 2").select(search.spans(F.col("text"), search.parse("row power"))).first()[0]
    assert [(h["set"], h["start"], h["length"]) for h in hits] == [(0, 0, 3), (1, 19, 5)]
    with pytest.raises(search.QueryError):
        search.parse("x")


def test_index_delta_and_optimize(spark, tmp_path):
    docs = spark.createDataFrame([(i, "indexed.row") for i in range(3)], "doc_id long, text string")
    index = search.TextIndex(spark, str(tmp_path / "ix"), "doc_id")
    index.create(docs, "text")
    index.add(spark.createDataFrame([(i, "indexed row") for i in range(3, 6)], "doc_id long, text string"))
    assert index.search("indexed-row").count() == 6
    assert not index.optimize(having_new_rows_over=3)
    assert index.optimize(having_new_rows_over=2) and index.new_rows() == 0
    assert index.search("indexed-row").count() == 6


def test_thesaurus_levels(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "term string, equiv string")
    assert [search.closure(pairs, level).count() for level in (1, 2, 3)] == [2, 4, 6]


def test_shifts_and_rotations_of_words_and_arrays(spark):
    import random

    rng = random.Random(2)
    cases = [([rng.randrange(1 << 32) for _ in range(k)], n) for k in (1, 2, 3) for n in (0, 1, 5, 31, 32, 33, 40, 64, 95, 96, 200, -1, -31, -32, -45, -200)]
    df = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(cases)], "i int, a array<bigint>, n int")
    a, n = F.col("a"), F.col("n")
    got = {r[0]: r[1:] for r in df.select("i", bits.bit_shift_left(a, n), bits.bit_shift_right(a, n), bits.bit_rotate_left(a, n), bits.bit_rotate_right(a, n)).collect()}
    for i, (words, by) in enumerate(cases):
        size = 32 * len(words)
        whole, mask = sum(w << 32 * j for j, w in enumerate(words)), (1 << size) - 1
        left = lambda k: (whole << k if k >= 0 else whole >> -k) & mask
        turn = lambda k: ((whole << k % size) | (whole >> (size - k % size))) & mask
        cut = lambda v: [v >> 32 * j & 0xFFFFFFFF for j in range(len(words))]
        assert [list(x) for x in got[i]] == [cut(left(by)), cut(left(-by)), cut(turn(by)), cut(turn(-by))], (words, by)


def test_nearest_of_each_query_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, size=(300, 4)).astype(float)  # exact sums, so that ties are ties
    m[100:130] = m[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", m[i].tolist()) for i in range(0, 300, 10)], "query_id string, q array<double>")
    for metric in ("dot", "l2sq"):
        got = {}
        for r in vectors.nearest_each(df, queries, 7, "v", "id", metric, block=8).collect():
            got.setdefault(r["query_id"], []).append((r["place"], r["id"]))
        for i in range(0, 300, 10):
            d = -(m @ m[i]) if metric == "dot" else ((m - m[i]) ** 2).sum(1)
            want = [x[1] for x in sorted((round(d[j], 9), j) for j in range(300))[:7]]
            assert [x for _, x in sorted(got[f"q{i}"])] == want, (metric, i)
