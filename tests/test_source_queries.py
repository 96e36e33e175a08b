import pytest
from oracle import assert_same

from lumenframe.plans.source_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_files_and_streams_match_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], ORACLES[name])
