import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from quirekit.plans import catalogue

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, AT)
    got = rows(df.columns, df.collect())
    assert got
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in cursor.description]
        want = rows(names, cursor.fetchall())
        assert sorted(names) == sorted(df.columns)
        assert got == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
