"""What the entry point registers of this subpackage."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from cohortpulse.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    registered = entry_point.queries()
    assert QUERIES.items() <= registered.items() and registered["pipeline"] is corpus_pipeline.run
    assert ORACLES.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, QUERIES[name](spark, FOLDER).select(*columns).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_conversations"}))
def test_query_covers_all_documents(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()} == ids
