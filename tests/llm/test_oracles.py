"""The queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from sessionlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.ORACLE_SQL[name])
    assert frame.columns == [d[0] for d in found.description]
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(found.fetchall(), key=repr)
