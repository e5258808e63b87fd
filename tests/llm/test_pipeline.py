"""The pipeline on a small corpus whose result is known."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import bpe


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = np.random.default_rng(8)
    plain = lambda n=60: " ".join(f"p{rng.integers(0, 900)}" for _ in range(n))
    texts, labels = {}, []
    for i in range(300):
        words = plain().split()
        if i % 5 == 0:
            for at in range(3, 40, 6):
                words[at] = f"bad{at % 3}"
        texts[i] = " ".join(words)
        labels.append((i, int(i % 5 == 0)))
    item = plain(30)
    texts |= {401: texts[1], 402: texts[2] + " end", 403: plain(20) + " " + item + " " + plain(20), 404: "clean text password=abcdefghijkl more", 405: None, 406: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = columns or docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i for i in texts if i not in left} == {i for i in range(0, 300, 5)} | {401, 402, 403}
    assert left[404] == "clean text [SECRET] more"
    assert all(left[i] == texts[i] for i in left if i != 404)

    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left)
    for i, text in left.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
