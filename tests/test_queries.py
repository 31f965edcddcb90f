import pytest
from tests.oracle import assert_equal

import __spark_entry__ as entry
from chromloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert_equal(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["cell_id", "n_unique", "kept", "log_reads"] and frame.count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
