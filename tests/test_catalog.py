"""The registered queries: names, SQL, and the flagship query end to end."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and all(0 <= r.eer <= 1 for r in rows)


@pytest.mark.parametrize("name", ["payee_edge_features", "sessionise", "trust_score", "decision_path", "decision_path_outcomes"])
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("orders", "lineitem", "events", "embeddings", "supplier"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = got[columns].sort_values(columns).reset_index(drop=True).round(4)
    b = want[columns].sort_values(columns).reset_index(drop=True).round(4)
    assert a.equals(b)
