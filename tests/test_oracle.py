"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from quadrat.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str), list(df.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    got, columns = rows(registry.QUERIES[name](spark, SF).toPandas())
    want, names = rows(duck.sql(registry.SQL[name]).df())
    assert columns == names
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
