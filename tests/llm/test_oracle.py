"""Queries of the subpackage against their SQL."""

import os

import duckdb
import pytest

from quadrat.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted((tuple(v.item() if hasattr(v, "item") else v for v in r) for r in df[columns].itertuples(index=False)), key=str)
    assert plain(got) == plain(want)


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))
