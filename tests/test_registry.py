"""Every registered query of the library against its SQL oracle on the smallest data."""

import os

import pytest

import __spark_entry__
from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, db, name):
    found = registry.queries()[name](spark, SF)
    got = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, got.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_core_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
