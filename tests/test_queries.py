"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from zymolith.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(value):
    if value is None:
        return "NULL"
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return str(float(value)) if isinstance(value, float) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert rows or name in ("j15_nearest_region",)
        return
    want = sql.sql(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
