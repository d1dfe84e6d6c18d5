"""Every registered query of the market operators against its SQL, over the smallest tables."""

import math

import pytest

from tidemark.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows(records):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return float(x) if hasattr(x, "quantize") else x

    return sorted(repr(tuple(plain(x) for x in r)) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_meets_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    want = duck.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({SQL[name]})")
    assert rows(df.select(*names).collect()) == rows(want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
