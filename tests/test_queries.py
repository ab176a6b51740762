"""Every query of the registry against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from forkweave.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return v if isinstance(v, str | bool) else int(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name == "domination_candidates"
    if name in registry.ORACLES:
        c = duckdb.connect()
        c.execute(f"create view events as select * from '{SF}/events.parquet'")
        want = c.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
