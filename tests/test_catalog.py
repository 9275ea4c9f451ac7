"""Every registered query with SQL against that SQL: column names, types and rows in any order."""

import os
from pathlib import Path

import pytest

from tessera import catalog

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        path = DATA / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: "NULL" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x)
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(catalog.SQL[name])
    types = {x[0]: str(x[1]) for x in cursor.description}
    want = normal([x[0] for x in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert {c: TYPES.get(t, types[c]) for c, t in df.dtypes} == types
    assert got[1] == want[1]


def test_run_agreement_counts_every_day(spark, tmp_path):
    day3 = [(run, u, 3, float(u)) for run in "ab" for u in range(4)]
    later = [("b", u, 20, 100.0 - 10 * u) for u in range(4)]
    e = spark.createDataFrame(day3 + later, "event_type string, user_id long, d int, value double")
    e.selectExpr("*", "make_timestamp(2024, 1, d, 0, 0, 0) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(catalog.QUERIES["run_agreement"](spark, str(tmp_path)).head()) == ("e", -1.0, 0.0, -1.0, -1.0)
