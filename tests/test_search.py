"""The index against the scan and against brute force, over generated texts and queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import search
from marlstone.operators.search import TextIndex, Words, match_index, match_scan, parse, postings

WORDS = "alpha beta gamma delta élan Élan elan naïve running runs straße Ωmega don't".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    glue = [" ", " ", ". ", "\n", "-", ", "]
    out = ["".join(rng.choice(WORDS) + rng.choice(glue) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    return [*out, None, "", "the of", "alpha 12 beta"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


def brute(texts, query):
    """Numbers of matching texts; words, wildcards and w/N only."""

    def at(words, item):
        for p in item.phrases:
            for i in range(len(words) - len(p) + 1):
                if all(re.fullmatch(".*".join(map(re.escape, w.split("*"))), x) for w, x in zip(p, words[i:], strict=False)):
                    yield i, i + len(p)

    def wanted(words):
        hit = lambda i: any(True for _ in at(words, i))
        maybe = [hit(i) for i in query.items if i.optional]
        return all(map(hit, query.required)) and (not maybe or sum(maybe) >= query.least)

    def one(t):
        if t is None or not query.items:
            return False
        words = query.words.split(t)
        if any(next(at(words, i), None) for i in query.items if i.negated):
            return False
        if isinstance(query.within, int):
            return any(wanted(words[i : i + query.within]) for i in range(max(len(words), 1)))
        return wanted(words)

    return {i for i, t in enumerate(texts) if one(t)}


QUERIES = [
    "alpha", "alpha beta", "alpha -beta", "-alpha", "-alpha -beta", "(alpha,gamma) delta", '"alpha beta"', "alpha-beta w/4", "alpha beta w/3", "alpha beta gamma @0 w/2",
    "alpha beta gamma @1", "+alpha beta gamma @0", "alpha gamma @0 -delta", "élan", "Élan -alpha", "na*", "al* be*", '"al* beta"', "r*n* w/1", "the", "", "the -alpha", "ωmega", "don't", "straße alpha w/5",
]


@pytest.mark.parametrize("words", [Words(), Words(search.ASCII), Words(fold=True), Words(stem=True, fold=True)], ids=["letters", "ascii", "folded", "stems"])
def test_index_and_scan_agree(docs, texts, words):
    index, keys = postings(docs, "doc_id", "text", words).cache(), docs.where("text is not null")
    queries = [q for q in QUERIES if words.pattern != search.ASCII or q.isascii()]
    parsed = [parse(q, words=words) for q in queries]
    scanned = docs.select("doc_id", *[match_scan(F.col("text"), q).alias(f"q{i}") for i, q in enumerate(parsed)]).collect()
    for i, q in enumerate(parsed):
        want = brute(texts, q)
        assert {r["doc_id"] for r in scanned if r[f"q{i}"]} == want, (queries[i], "scan")
        assert {r[0] for r in match_index(index, q, "doc_id", keys).collect()} == want, (queries[i], "index")
    one = parse("alpha -beta w/4", words=words)
    assert {r[0] for r in match_index(postings(docs, "doc_id", "text", words, one), one, "doc_id", keys).collect()} == brute(texts, one)
    with pytest.raises(search.QueryError):
        match_index(index, parse("-alpha", words=words), "doc_id")


def test_other_matchers_and_units(docs, texts):
    index = postings(docs, "doc_id", "text")
    for q, want in (
        (r"/al.ha\s+beta", lambda t: re.search(r"al.ha\s+beta", t)),
        ("alpha #>10", lambda t: "alpha" in search.PLAIN.split(t) and re.search(r"\d", t)),
        ("%75alphx", lambda t: (text.best_closeness(t, "alphx", 75) or 0) >= 75),
        ("alpha beta w/line", lambda t: any({"alpha", "beta"} <= set(search.PLAIN.split(x)) for x in t.split("\n"))),
        ("alpha beta w/sent", lambda t: any({"alpha", "beta"} <= set(search.PLAIN.split(x)) for x in re.split(r"(?<=[.?!])\s+", t))),
    ):
        query, expected = parse(q), {i for i, t in enumerate(texts) if t is not None and want(t)}
        assert {r[0] for r in docs.where(match_scan(F.col("text"), query)).collect()} == expected, q
        assert {r[0] for r in match_index(index, query, "doc_id", docs=docs).collect()} == expected, q
        with pytest.raises(search.QueryError):
            match_index(index, query, "doc_id")


def test_closeness_of_every_part():
    def slow(t, pattern):
        n, best = len(pattern), 0.0
        for i in range(max(1, len(t) - n + 1)):
            if t[i] in pattern:
                w = t[i : i + n]
                best = max(best, sum(max((n - abs(j - k) for j in range(len(w)) if w[j] == c), default=0) for k, c in enumerate(pattern)) / n**2)
        return int(best * 100)

    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 40)))
        p = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
        assert (text.best_closeness(t, p, 1) or 0) == slow(t, p), (t, p)


def test_index_opens_again_and_counts_a_batch_once(spark, tmp_path):
    folder = f"file://{tmp_path}/ix"
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    TextIndex(spark, folder, "doc_id").create(rows((1, "alpha beta"), (2, None), (3, "")), "text", Words(fold=True))
    TextIndex(spark, folder).add(rows((4, "Álpha")), 0)
    again = TextIndex(spark, folder)
    again.add(rows((4, "Álpha")), 0)
    assert sorted(r[0] for r in again.search("alpha").collect()) == [1, 4] and again.new_rows() == 1
    assert sorted(r[0] for r in again.search("-alpha").collect()) == [3]
    assert again.optimize()
    merged = TextIndex(spark, folder)
    merged.add(rows((4, "Álpha")), 0)
    assert merged.new_rows() == 0 and sorted(r[0] for r in merged.search("alpha").collect()) == [1, 4]
    merged.add(rows((5, "alpha")), 1)
    assert sorted(r[0] for r in TextIndex(spark, folder).search("alpha").collect()) == [1, 4, 5]


def test_thesaurus_closes_over_long_chains(spark):
    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(40)], "term string, equiv string")
    assert search.closure(chain, 3).count() == 41 * 40
    found = search.synonyms_of(chain, ["t0"], 3)
    assert len(found["t0"]) == 40 and len(parse("~t0", found, words=Words(r"[\p{L}0-9]+")).items[0].phrases) == 41
