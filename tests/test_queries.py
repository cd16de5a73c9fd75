"""Every catalogue query against its SQL, and the entry points' contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from pairloom.plans.catalog import QUERIES
from tools.check_oracles import rows_of

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(entry_points.oracle_sql()) >= set(NAMES)
    assert set(entry_points.queries()) >= set(entry_points.oracle_sql())


def test_entry_is_lazy_and_has_rows(spark):
    assert len(entry_points.entry(spark).collect()) == 1


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, db, name):
    df = entry_points.queries()[name](spark, small)
    result = db.execute(entry_points.oracle_sql()[name])
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(df.columns, df.collect()) == theirs
