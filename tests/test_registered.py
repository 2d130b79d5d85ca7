"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from stratalake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "NULL" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(name, spark, con, sf_dir):
    got = catalog.queries()[name](spark, sf_dir)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
