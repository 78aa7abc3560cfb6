import pytest

from sql import compare
from strandline.plans import series_queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, sf, name):
    n = compare(q.QUERIES[name](spark, sf), q.ORACLES[name], sf)
    assert n > 0


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLES)


def test_range_and_filter_reach_the_scan(spark, sf):
    plan = q.QUERIES["filter_and"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,20.0)" in plan and "LessThanOrEqual(value,60.0)" in plan
    assert "user_id" not in plan.split("ReadSchema")[1]


def test_lists_differ_beyond_the_first_component(spark, tmp_path):
    rows = [(1, "a", [0.5, 1.0]), (2, "a", [0.5, 2.0]), (3, "b", [0.5, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.vec_id for r in q.QUERIES["filter_list_ne"](spark, str(tmp_path)).collect()] == [2]
