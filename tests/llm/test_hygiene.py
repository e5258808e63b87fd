"""Nulls, repeated rows, long texts, ties, empty tables and clashing columns, and accuracy on held-out rows."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, langid, license_scan, sharding, toxicity
from marlstone.session import load

DATA = Path("/root/testdata/sf0.01")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
WIDE = "doc_id long, text string, lang string, source string, n long, y double, w string, dir string, own string, basis string, shard int, slot int, key long, marks string, row long"


def wide(spark, rows):
    """Documents whose further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "w", "d", "o", "b", 1, 2, 3, "m", 4) for i, t in rows], WIDE)


ROWS = [(1, "plain text here"), (1, "plain text here"), (None, "plain text here"), (None, None), (2, ""), (3, LONG), (4, "é 日本")]


def test_sharding_of_all_kinds_of_rows(spark):
    got = sharding.shard_rows(wide(spark, ROWS * 30), shards=40).collect()
    n = len(ROWS) * 30
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): 0 for i, t in ROWS} | {k: v * 30 for k, v in Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS).items()})
    by_shard = Counter(r["shard"] for r in got)
    assert set(by_shard) == set(range(40)) and max(by_shard.values()) - min(by_shard.values()) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by_shard[s]))
    assert sorted(r["row_no"] for r in got) == list(range(n))
    at = sharding.permute(np.array([r["row_no"] for r in got]), n, 7)
    assert all((r["shard"], r["slot"]) == (p % 40, p // 40) for r, p in zip(got, at.tolist(), strict=True))
    assert all(sharding.row_at(r["shard"], r["slot"], 40, n, 7) == r["row_no"] for r in got[:20])
    many = wide(spark, [(None, f"t{i}") for i in range(2000)])
    bucket = F.pmod(F.xxhash64("doc_id", "c", "size"), F.lit(sharding.BUCKETS))
    lean = many.select("doc_id", F.crc32("text").alias("c"), (F.length("text") + 16).cast("long").alias("size"))
    assert lean.select(bucket.alias("b")).distinct().count() > 1000  # null ids are spread
    assert sharding.shard_rows(wide(spark, [])).count() == 0


def test_language_of_all_kinds_of_rows(spark):
    texts = ["the cat and the dog and the bird", "der Hund und die Katze und der Vogel"]
    rows = [(i, f"{texts[i % 2]} {i}", ("en", "de")[i % 2]) for i in range(120)] + [(None, texts[0], "en"), (500, None, "en"), (501, "", "de"), (502, "12 !", "de"), (503, (texts[1] + " ") * 2000, None), (503, (texts[1] + " ") * 2000, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, score string")
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (500, 501, 502)] == ["und"] * 3
    assert [r["lang_pred"] for r in got if r["doc_id"] == 503] == ["de", "de"] and [(r["lang_pred"], r["held_out"]) for r in got if r["doc_id"] is None] == [("en", False)]
    assert langid.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = load(spark, str(DATA), "documents"), load(spark, str(DATA), "labels")
    found = langid.predict(docs, langid.train(docs)).where("held_out").join(docs.select("doc_id", "lang", F.col("text").rlike(r"\p{L}").alias("some")), "doc_id").where("some and lang is not null").collect()
    assert len(found) > 200 and sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in scored)
    assert hit >= 0.6 * sum(r["toxic"] for r in scored) and hit >= 0.8 * sum(r["predicted"] for r in scored)
    order = np.array([r["score"] for r in scored])
    toxic = np.array([r["toxic"] for r in scored], dtype=bool)
    assert order[toxic].mean() > 5 * order[~toxic].mean()


def test_toxicity_of_all_kinds_of_rows(spark):
    rng = np.random.default_rng(3)
    clean = lambda: " ".join(f"p{rng.integers(0, 200)}" for _ in range(40))
    rows = [(i, clean() + (" vile#1 rotten!" * 3 if i % 6 == 0 else "")) for i in range(300)] + ROWS[3:5] + [(400, LONG), (401, clean() + " VILE rotten vile rotten"), (401, "p1 p2")]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)] + [(0, 0), (5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(wide(spark, rows), labels)
    got = toxicity.score(wide(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] != 2)
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 401) == [0, 1]
    assert [r["predicted"] for r in got if r["doc_id"] == 400 or r["doc_id"] is None] == [0, 0]
    assert toxicity.score(wide(spark, []), model).count() == 0
    kept = toxicity.keep_clean(wide(spark, rows), labels)
    assert kept.columns == WIDE.replace(",", "").split()[::2] and 250 <= kept.count() < len(rows)
    for one in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        scores = {r["score"] for r in toxicity.score(wide(spark, rows), toxicity.train(wide(spark, rows), one)).collect()}
        assert len(scores) == 1
    assert toxicity.keep_clean(wide(spark, rows), labels.limit(0)).count() == len(rows)


def test_licences_of_all_kinds_of_rows(spark):
    mit = license_scan.TEMPLATES["mit"][0]
    rows = [(1, f"{mit}"), (1, f"{mit}"), (2, None), (3, ""), (4, LONG + f"\n\n{mit}"), (5, "code"), (None, "code")]
    paths = F.when(F.col("doc_id") == 5, F.lit("a/b/x.c")).when(F.col("doc_id") == 1, F.lit("a/LICENSE"))
    docs = wide(spark, rows)
    got = license_scan.scan(docs, paths).collect()
    assert Counter((r["doc_id"], r["licence"], r["basis"]) for r in got) == Counter({(1, "mit", "own"): 2, (2, None, "none"): 1, (3, None, "none"): 1, (4, "mit", "own"): 1, (5, "mit", "inherited"): 1, (None, None, "none"): 1})
    assert license_scan.scan(docs.limit(0), paths).count() == 0


def test_cosine_against_brute_force():
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(30)]
    templates = {f"l{k}": [" ".join(rng.choice(vocabulary, 12)) for _ in range(2)] for k in range(5)}
    m = license_scan.Matcher(templates)
    texts = [t for k in sorted(templates) for t in templates[k]]
    bags = [license_scan.terms(t) for t in texts]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df.get(w, 0))) + 1
    vector = lambda b: {w: n * idf(w) for w, n in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    for _ in range(50):
        text = " ".join(rng.choice([*vocabulary, "other", "words"], int(rng.integers(1, 25))))
        v = vector(license_scan.terms(text))
        cosines = [sum(x * vector(b).get(w, 0.0) for w, x in v.items()) / norm(v) / norm(vector(b)) for b in bags]
        name, cosine = m.nearest(text)
        assert (name is None and max(cosines) == 0) or abs(cosine - max(cosines)) < 1e-9
        if name:
            assert any(abs(c - cosine) < 1e-9 and name == sorted(templates)[i // 2] for i, c in enumerate(cosines))


def test_pipeline_of_all_kinds_of_rows(spark, tmp_path):
    docs = wide(spark, ROWS + [(9, "token=abcdefghijkl")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == len(ROWS) + 1, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([i for i, _ in ROWS] + [9])
    lean = {(r["doc_id"], r["n_tokens"]) for r in bpe.digest(docs).collect() if r["doc_id"] != 9}
    assert {(r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] != 9} == lean
