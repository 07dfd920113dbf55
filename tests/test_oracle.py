"""Every named query at the smallest scale against its SQL."""

import pathlib

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="tables are not there")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    _, message = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert not message, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "page_type", "links"] and df.count() > 0
