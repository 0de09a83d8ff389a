"""The queries of the subpackage against their SQL, on the smallest data."""

import pytest

from capturelake.llm import queries

from tests.test_oracle import compare


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    compare(spark, sf, name)
