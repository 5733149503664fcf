"""Every registered query against its SQL, on the smallest tables."""

import oracle
import pytest

from vernissage.catalog import load
from vernissage.catalog.registry import ORACLE, QUERIES

load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    assert oracle.compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SF) == ""
