"""The opN_ queries with SQL give the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from vellum.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want) and want
