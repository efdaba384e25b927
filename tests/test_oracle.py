"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from veilspark.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert oracle.compare(df, db, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
