import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "version_lineage", "current_versions", "section_chunks", "clean_lines", "extracted_documents", "batch_status", "batch_progress", "vector_topk",
    "id_boost", "refs_extracted", "name_similarity", "page_links", "page_documents", "download_index", "url_checks", "message_guard", "request_fields",
    "stream_throughput", "stream_sliding", "stream_sessions", "backfill_counts", "vector_literals", "answers_by_id", "sink_commits",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if hasattr(value, "year") else value


def ordered(data):
    return sorted((tuple(map(plain, r)) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {','.join(cols)} FROM ({entry_point.oracle_sql()[name]})").fetchall()
    assert ordered(df.select(*cols).collect()) == ordered(want)


def test_every_query_has_sql_and_flagship_runs(spark):
    own = set(entry_point.queries()) - set(entry_point.LLM_QUERIES)
    assert own == set(entry_point.oracle_sql()) - set(entry_point.LLM_ORACLE)
    got = entry_point.entry(spark)
    assert got.count() == 40 and "citations" in got.columns
