"""Queries that SQL can express, against DuckDB; and the registry's shape."""

import os

import duckdb
import pytest

from tessera.llm import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = registry.queries()[name](spark, FOLDER)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())
