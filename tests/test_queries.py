import pytest

import __spark_entry__ as entry
from checks import DATA, same_rows
from loomline.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, oracle, name):
    assert name in ORACLES
    same_rows(QUERIES[name](spark, DATA), oracle, ORACLES[name])


def test_entry_point(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "vec_id", "score", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
