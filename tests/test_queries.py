"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from comboscan.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(columns, data):
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
