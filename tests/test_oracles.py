"""Every registered query against its DuckDB form on the small tables."""

import os

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from corpusrules.plans.catalog import QUERIES
from corpusrules.plans.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con(spark):
    # other tests run without it, to save compile time
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield duck(SF_DIR)
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
