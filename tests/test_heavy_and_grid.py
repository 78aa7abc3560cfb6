import pytest

from strandline.operators.heavy_keys import heavy_hitters, per_key
from strandline.operators.regular_grid import instant_ns, regular_series
from strandline.plans import problems



@pytest.mark.parametrize("name", sorted(problems.ORACLES))
def test_against_sql(spark, sf, name):
    from sql import compare  # beside this file

    compare(problems.QUERIES[name](spark, sf), problems.ORACLES[name], sf)


def test_every_heavy_key_is_named(spark):
    df = spark.range(100_000).selectExpr("case when id % 3 = 0 then 1 when id % 20 = 1 then 2 when id % 7 = 0 then null else id end k")
    keys, n = heavy_hitters(df, "k", 0.01)
    assert n == 100_000 and set(keys) == {1, 2}
    with pytest.raises(ValueError):
        heavy_hitters(df, "k", 0.0001)


def test_per_key_cases(spark):
    rows = [(1, t, t, str(t), "x") for t in range(3000)] + [(2, 5, 1, "a", "x"), (2, 5, 2, None, "x"), (3, None, 1, "z", "x"), (None, 1, 1, "q", "x")]
    df = spark.createDataFrame(rows, "key long, ts long, o long, val string, n string")
    got = {r.key: r for r in per_key(df, "key", "ts", "o", "val").collect()}
    assert set(got) == {1, 2, 3} and got[1].n == 3000 and got[1].latest == "2999" and got[1].total == 3004
    assert got[2].latest is None and got[2].last_ts == 5 and got[3].first_ts is None and got[3].n == 1
    assert per_key(df.limit(0), "key", "ts", "o", "val").count() == 0


def test_grid_cases(spark):
    s = 10**9
    rows = [(1, 1 * s, 1.0, 1, 10 * s), (1, 2 * s, 2.0, 2, 10 * s), (1, 2 * s, 3.0, 3, 10 * s), (1, 65 * s, 4.0, 4, 10 * s), (2, 5 * s, 9.0, 5, 10 * s)]
    df = spark.createDataFrame(rows, "tag_key long, at_ns long, v double, point_id long, period_ns long")
    got = {(r.tag_key, r.slot_ns // s): (r.n, r.value, r.state) for r in regular_series(df, 3).collect()}
    assert got == {
        (1, 0): (3, 3.0, "observed"), (1, 10): (0, 3.0, "filled"), (1, 20): (0, 3.0, "filled"), (1, 30): (0, 3.0, "filled"),
        (1, 40): (0, None, "missing"), (1, 50): (0, None, "missing"), (1, 60): (1, 4.0, "observed"), (2, 0): (1, 9.0, "observed"),
    }
    assert regular_series(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    one = 1_609_722_509
    units = spark.createDataFrame([(one,), (one * 1000,), (one * 10**6,), (one * 10**9,)], "t long")
    assert {r[0] for r in units.select(instant_ns(F.col("t"))).collect()} == {one * s}


def test_series_spans_days(spark):
    s, day = 10**9, 86_400 * 10**9
    hour, week = 3600 * s, 7 * 86_400 * s
    rows = [(1, 22 * hour, 1.0, 1, hour), (1, 3 * day + 2 * hour, 2.0, 2, hour), (1, 3 * day + 4 * hour, 3.0, 3, hour), (2, 0, 5.0, 4, week), (2, 2 * week, 6.0, 5, week)]
    rows += [(3, 20 * hour, 7.0, 6, 7 * hour), (3, 2 * day, 8.0, 7, 7 * hour)]  # a period that doesn't divide the day
    df = spark.createDataFrame(rows, "tag_key long, at_ns long, v double, point_id long, period_ns long")
    got = [(r.tag_key, r.slot_ns, r.n, r.value, r.state) for r in regular_series(df, 3).orderBy("tag_key", "slot_ns").collect()]
    seen = {22: 1.0, 74: 2.0, 76: 3.0}
    want = [(1, k * hour, 1, seen[k], "observed") if k in seen else (1, k * hour, 0, 1.0 if k < 26 else 2.0, "filled") if k < 26 or k == 75 else (1, k * hour, 0, None, "missing") for k in range(22, 77)]
    want += [(2, 0, 1, 5.0, "observed"), (2, week, 0, 5.0, "filled"), (2, 2 * week, 1, 6.0, "observed")]
    want += [(3, k * hour, int(k in (14, 42)), 8.0 if k == 42 else 7.0, "observed" if k in (14, 42) else "filled") for k in range(14, 43, 7)]
    assert got == want
    assert regular_series(df, 3, within_day=True).count() == 8


def test_series_has_more_than_the_days_where_gaps_span_midnight(spark, sf01):
    from sql import compare

    whole, found = (problems.QUERIES[k](spark, sf01) for k in ("p3_grid", "p3_found"))
    compare(whole, problems.ORACLES["p3_grid"], sf01)
    empty = whole.where("n = 0").select("tag_key", "slot_ns")
    assert found.join(empty, ["tag_key", "slot_ns"], "left_anti").count() == 0 and empty.count() > found.count() > 0
