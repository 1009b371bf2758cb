"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest

from check import compare, connect
from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(spark, duck, name):
    _, message = compare(QUERIES[name].run(spark, FOLDER), duck, QUERIES[name].sql)
    assert not message, message


def test_every_query_has_a_survey_id():
    assert all(n.split("_")[0].rstrip("0123456789") in {"S", "P", "C", "E", "L", "F", "Q", "K", "M", "V", "X", "A"} for n in QUERIES)
