"""Every statement against its query on the smallest tables; every other query gives rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodeworks.plans import analytics, governance, histories, reports, scores, states, structures  # noqa: F401
from lodeworks.plans import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


#: Queries that may find nothing in the smallest tables.
EMPTY = {"hotspot_issues", "secret_lines", "years_in_lines", "duplicate_blocks", "dangerous_calls_derived", "class_findings", "file_findings", "missing_tests", "documentation_styles", "low_maintainability"}


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_statement(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    answer = duck.execute(own.ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(names)
    rows = df.collect()
    assert plain([tuple(r) for r in rows], df.columns) == plain(answer.fetchall(), names)
    assert rows or name in EMPTY


@pytest.mark.parametrize("name", sorted(own.QUERIES.keys() - own.ORACLES.keys()))
def test_rows(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
