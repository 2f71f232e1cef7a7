"""Every query against its independent SQL."""

import pytest
from comparing import duck_rows, spark_rows

from opfold.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(ORACLES[name], sf_dir)
