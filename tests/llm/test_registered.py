"""Registered queries against their SQL, and the pipeline against brute force on a small fixture."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry_point
import corpus_pipeline
from lexgrove.llm import queries
from lexgrove.llm.queries_sql import ORACLE

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {','.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_point.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_dedup", "decontaminate", "pieces"]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in seen.collect()}
        seen = corpus_pipeline.stored(stage(spark, seen, sf), f"test-{name}")
        after = {r.doc_id: r for r in seen.collect()}
        assert set(after) <= set(before)
        if name != "pieces":
            assert seen.columns == docs.columns
        if name == "language":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "lines":
            assert set(after) == set(before) and all(set(r.text.split("\n")) <= set(before[i].text.split("\n")) | {""} for i, r in after.items())
        if name == "near_dedup":
            grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
            sets = {i: grams(r.text) for i, r in before.items()}
            alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            assert not [(a, b) for a in after for b in after if a < b and alike(a, b) >= 0.9]
            assert all(any(alike(i, j) >= 0.7 for j in before if j != i) for i in set(before) - set(after))
        if name == "decontaminate":
            joined = {i: " " + " ".join(r.text.lower().split()) + " " for i, r in before.items()}
            assert set(after) == {i for i, t in joined.items() if not any(f" {' '.join(b)} " in t for b in bench if len(b) >= 7)}
        if name == "pieces":
            assert set(after) == set(before) and all(len(r.ids) == r.n_tokens for r in after.values())


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test-empty")
    assert docs.count() == 0
