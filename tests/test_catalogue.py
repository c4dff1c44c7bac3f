import duckdb
import pytest

from keyloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", catalogue.NAMES)
def test_query_agrees_with_sql(spark, other, name):
    got = catalogue.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    here = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    if name in catalogue.oracle_sql():
        there = other.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        assert here == sorted(map(repr, there))
    else:
        assert here


def test_flagship_is_a_permutation(spark):
    got = catalogue.flagship(spark, DIR).collect()
    assert sorted(r.mph for r in got) == list(range(len(got)))
