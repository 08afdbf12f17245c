"""Queries with an oracle equal DuckDB; all have the contract's columns."""

import pytest

from careerloom.llm import queries
from tests.test_oracles import duck, normal  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, duck, name):  # noqa: F811
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert normal(got).equals(normal(want))
