import math

import numpy as np
import pytest

from sql import compare
from strandline.llm import queries
from strandline.llm.percentiles import day_summaries, from_ordered_bits, ordered_bits, percentiles_from_summaries, radix_percentiles


def test_bits_keep_the_order_and_round_trip():
    v = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 1e300, np.inf])
    b = ordered_bits(v)
    assert (np.diff(b) >= 0).all() and b[4] == b[5]
    assert (from_ordered_bits(b) == v).all()


def test_bounded_and_exact(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1e6, 900), rng.normal(0, 1e-6, 900), np.zeros(600)])
    rows = [(1 if i % 3 else 2, float(x), i % 4, "extra") for i, x in enumerate(v)]
    rows += [(1, None, 0, ""), (1, float("nan"), 0, ""), (1, float("inf"), 0, ""), (None, 1.0, 0, ""), (3, None, 0, "")]
    df = spark.createDataFrame(rows, "grp int, v double, day int, q string")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]

    def exact(g, q):
        x = sorted(r[1] for r in rows if r[0] == g and r[1] is not None and math.isfinite(r[1]))
        return x[max(1, math.ceil(q * len(x))) - 1]

    for r in radix_percentiles(df, "grp", "v", probs).collect():
        assert r.low == r.high == exact(r.grp, r.q)
    parts = day_summaries(df.where("day < 2"), "grp", "v", "day").unionByName(day_summaries(df.where("day >= 2"), "grp", "v", "day"))
    whole = percentiles_from_summaries(parts, "grp", probs).collect()
    assert len(whole) == 10
    for r in whole:
        x = exact(r.grp, r.q)
        assert r.low <= x <= r.high and abs(r.high - r.low) <= max(abs(x) / 128, 1e-300)
    assert radix_percentiles(df.limit(0), "grp", "v", probs).count() == 0
    with pytest.raises(ValueError):
        radix_percentiles(df, "grp", "v", [1.5])


def test_day_summaries_hold_the_exact_percentiles(spark, sf):
    exact = {(r.attr_code, r.q): r.value for r in queries.p2_percentiles(spark, sf).collect()}
    rough = queries.p2_from_days(spark, sf).collect()
    assert len(rough) == len(exact)
    assert all(r.low <= exact[r.attr_code, r.q] <= r.high for r in rough)


@pytest.mark.parametrize("name", ["p2_percentiles", "p2_day_summaries", "p2_from_days"])
def test_against_sql(spark, sf, name):
    assert compare(getattr(queries, name)(spark, sf), queries.ORACLES[name], sf)
