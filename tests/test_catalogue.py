"""Every query of the catalogue that has SQL gives what DuckDB gives."""

import pytest

from millrace.plans import catalogue
from tests import parity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.views(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, con, name):
    parity.compare(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, FOLDER).collect()
