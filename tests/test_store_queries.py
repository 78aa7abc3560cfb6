import pytest

from sql import compare
from strandline.plans import store_queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_against_sql(spark, sf, name):
    compare(q.QUERIES[name](spark, sf), q.ORACLES[name], sf)
