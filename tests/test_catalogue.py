"""Every query of the catalogue against its SQL in DuckDB: columns, types of columns that hold numbers, and rows."""

import duckdb
import pytest

from sessionlake.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    expected = sorted((rounded(r[names.index(c)] for c in order) for r in found.fetchall()), key=repr)
    assert sorted((rounded(r[c] for c in order) for r in frame.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_query_reads_more_columns_than_it_needs(spark, sf_dir):
    plan = QUERIES["project_catalog"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string,source:string>" in plan
