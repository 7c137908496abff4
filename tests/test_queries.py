"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from conftest import SF, rows_in, rows_of

import __spark_entry__
from slatewise.operators import match
from slatewise.plans import archives, files, matching

QUERIES = {**matching.QUERIES, **files.QUERIES, **archives.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    query, oracle = QUERIES[name]
    assert rows_of(query(spark, SF)) == rows_in(sql.sql(oracle))


def test_candidates_of_cut_buckets(spark, tmp_path, monkeypatch):
    """What larger tables bring: buckets of many cells, large keys, rows of one name, sizes null, zero and below."""
    import duckdb

    monkeypatch.setattr(match, "CELL", 7)
    c = duckdb.connect()
    copies = "SELECT p_partkey + CAST(i AS BIGINT) * 1000003 AS p_partkey, p_brand, CASE WHEN p_partkey % 31 > 2 THEN p_size WHEN p_partkey % 31 > 0 THEN -10 * (p_partkey % 31) END AS p_size"
    parts = f"SELECT p_partkey, p_brand, CAST(p_size AS INTEGER) AS p_size FROM ({copies} FROM '{SF}/part.parquet', (VALUES (0), (1), (5000), (5000)) t(i))"
    c.execute(f"COPY ({parts}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    query, oracle = QUERIES["score_candidates"]
    got, want = rows_of(query(spark, str(tmp_path))), rows_in(c.sql(oracle))
    assert got == want and any(float("inf") in row for row in got[1])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 38
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.oracle_sql())
