"""Every registered query equals its SQL run by DuckDB on the same tables."""

import decimal
import glob
import os

import duckdb
import pytest

from gristmill import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return str(round(float(v), 9)) if v == v else "None"
    return str(v)


def sorted_rows(rows, names, order):
    return sorted(tuple(plain(r[names.index(n)]) for n in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == list(dict.fromkeys(df.columns))
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted_rows(rows, df.columns, sorted(df.columns)) == sorted_rows(cur.fetchall(), names, sorted(df.columns))
    else:
        assert rows


def test_entry_has_rows_and_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
