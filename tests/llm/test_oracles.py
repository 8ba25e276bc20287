"""The operators that SQL can express give what their SQL gives."""

import pytest

from millrace.llm import registry
from tests import parity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert parity.compare(registry.queries()[name](spark, FOLDER), parity.views(FOLDER), registry.oracle_sql()[name]) > 0
