"""The registered queries with SQL against that SQL."""

from pathlib import Path

import pytest

from tessera.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    cursor = con.execute(queries.SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))
