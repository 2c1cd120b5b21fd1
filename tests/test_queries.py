"""Every registered T-SQL query against the SQL that DuckDB answers alike."""

import duckdb
import pytest

from quillon import queries as Q

TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return d


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, sf, name):
    df, rel = Q.QUERIES[name](spark, sf), duck.sql(Q.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert rows(df.select(*(f"`{c}`" for c in columns)).collect()) == rows(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from rel").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
