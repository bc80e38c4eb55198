"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

import duckdb
import pytest

from lakesift import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if type(v).__name__ == "Decimal" and v == int(v) else v


def rows_of(names, rows):
    return sorted((tuple(plain(r[i]) for i in names) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cursor = duck.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(theirs)
    order = sorted(df.columns)
    assert rows_of([df.columns.index(c) for c in order], df.collect()) == rows_of([theirs.index(c) for c in order], cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
