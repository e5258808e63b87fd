import importlib.util
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.plans import catalogue, functional
from marlstone.plans.registry import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 4) + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 4) + 0.0)
    return repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in ORACLE:
        return
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggestions_come_from_the_whole_vocabulary(spark, tmp_path):
    rng = random.Random(3)
    near = lambda w: "".join(rng.choice(["", c, c, c, c, c, c + rng.choice("ersn")]) for c in w)
    texts = [" ".join(near(rng.choice(["license", "version", "under", "nder"])) for _ in range(6)) for _ in range(80)]
    texts += ["license a license", "version in one", "under it", *["nder"] * 60, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = Counter(w for t in texts for w in set((t or "").split()))
    want = {}
    for word in ("licensse", "versoin", "underr"):
        found = [(e, -n, w) for w, n in df.items() if 0 < (e := edits(word, w)) <= 2]
        want[word] = min(found)[2::-2]
    got = QUERIES["suggestions"](spark, str(tmp_path)).collect()
    assert {r["word"]: (r["suggestion"], r["edits"]) for r in got} == want


@pytest.mark.parametrize(("n", "ranges"), [(0, 4), (60, 4), (3000, 8)])
def test_every_row_has_a_place(spark, n, ranges):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "Same", "sAME", "".join(rng.choice("aAbBcC") for _ in range(4))])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(5)
    got = functional.placed(df, F.collate("name", "UTF8_LCASE"), "id", ranges).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, (r[1] or "").lower(), r[0]))
    assert [(r["id"], r["name"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, n + 1))


def test_entry_works_without_the_optional_subpackage(tmp_path):
    (tmp_path / "marlstone").mkdir()
    for p in ROOT.glob("marlstone/**/*.py"):
        to = tmp_path / p.relative_to(ROOT)
        if "llm" not in to.parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'nation_revenue' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_entry_lists_every_query():
    spec = importlib.util.spec_from_file_location("entry_module", ROOT / "__spark_entry__.py")
    e = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(e)
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
