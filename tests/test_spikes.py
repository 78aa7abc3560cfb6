import numpy as np
import pandas as pd
import pytest

from strandline.operators import spikes as sp
from strandline.operators.spikes import SpikeRules, implausible, peaks, running_level, tail_cutoff
from strandline.plans import problems

SCHEMA = "row_id long, tag string, ts_ns long, val double, phys_min string"


def binned(rows):
    """Histogram of one whole series."""
    return pd.DataFrame(rows, columns=["bin", "n", "s", "m", "q"])


def brute(d: pd.DataFrame, bounds: pd.DataFrame, rules=SpikeRules()) -> pd.DataFrame:
    """Both results over each whole series in memory: (row_id, method, found), by the rules written out anew; only the fits are the operator's."""
    d = d[d.tag.notna() & d.val.notna()]
    limits = bounds.set_index("tag")
    out = []
    for tag, rows in d.sort_values(["ts_ns", "row_id"]).groupby("tag"):
        x = rows.drop_duplicates("ts_ns")
        v = x.val.clip(-1e150, 1e150).to_numpy()
        r = v - pd.Series(v).rolling(21, center=True, min_periods=1).median().to_numpy()
        hour = (x.ts_ns.to_numpy() // 3_600_000_000_000 % 24).astype(int)
        scatter, still = sp.scatter_of(binned([*sp.bins(r), sp.steps(v, 0, len(v), 1e-6)]))
        season = np.array([np.clip(r[(hour == h) & (abs(r) <= 4 * scatter)].sum() / max(1, ((hour == h) & (abs(r) <= 4 * scatter)).sum()), -scatter / 2, scatter / 2) for h in range(24)])
        size = np.abs(r - season[hour])
        cutoff = sp.cutoff_of(binned(sp.bins(size[size <= 4 * scatter])), scatter, rules)
        hit = (v < limits.phys_min.get(tag, np.nan)) | (v > limits.phys_max.get(tag, np.nan))
        same = np.r_[False, np.abs(np.diff(v)) <= 1e-6]
        edges = np.flatnonzero(np.diff(np.r_[0, same.astype(int), 0]))
        for a, b in zip(edges[::2], edges[1::2]):
            if still < 0.5 and b - a + 1 >= 12:
                hit[a - 1 : b] = True
        method = hit | (size > cutoff)
        over = (np.abs(r) > 9 * scatter) & (np.abs(r) > 1e-6)
        assert (size[over] > cutoff).all(), tag  # as the operator's proof says
        edges = np.flatnonzero(np.diff(np.r_[0, over.astype(int), 0]))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a <= 3 and a > 0 and b < len(v):
                before, after = np.median(v[max(0, a - 8) : a]), np.median(v[b : b + 8])
                if all((y - before) * (y - after) > 0 and min(abs(y - before), abs(y - after)) > 9 * scatter for y in v[a:b]):
                    hit[a:b] = True
        of = pd.Series(range(len(v)), index=x.ts_ns)[rows.ts_ns].to_numpy()
        out.append(pd.DataFrame({"row_id": rows.row_id, "method": method[of], "found": hit[of], "cutoff": cutoff, "size": size[of]}))
    return pd.concat(out)


def test_chunked_equals_whole_series(spark, sf01):
    d = spark.read.parquet(f"{sf01}/tag_points.parquet").toPandas()
    bounds = spark.read.parquet(f"{sf01}/tag_dictionary.parquet").toPandas()
    want = brute(d, bounds)
    got = [r.row_id for r in problems.p5_found(spark, sf01).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(want.row_id[want.found])
    method = [r.row_id for r in problems.p5_method(spark, sf01).collect()]
    assert len(method) == len(set(method))
    close = set(want.row_id[np.isclose(want["size"], want.cutoff, rtol=1e-9)])  # sums of doubles in another order
    assert set(method) - close == set(want.row_id[want.method]) - close and set(got) < set(method)
    share = len(method) / len(want)
    assert 0.012 < share < 0.08, share


def test_cases(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(10, 1, 600)
    v[100:103] = 60  # spike of three
    v[200:204] = 60  # four: no spike
    v[300:312] = 9.5  # stuck
    v[400:] += 80  # a new level that stays
    v[398:400] = 50  # on the way there
    v[500] = 5000
    rows = [(i, "a", i * 60_000_000_000, float(x), "") for i, x in enumerate(v)]
    rows += [(9000, "a", 100 * 60_000_000_000, 60.0, ""), (9001, None, 5, 1e9, ""), (9002, "a", 7, None, ""), (9003, "a", 8, float("nan"), "")]
    rows += [(10_000 + i, "flat", i, 5.0, "") for i in range(100)] + [(11_000, "lone", 1, 5.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    bounds = spark.createDataFrame([("a", None, 1000.0), ("flat", 6.0, None)], "tag string, phys_min double, phys_max double")
    for size in (20_000, 7, 1):
        got = {r.row_id: r for r in implausible(df, bounds, rules=SpikeRules(size=size)).collect()}
        assert {k for k, r in got.items() if r.spike} == {100, 101, 102, 9000, 500}
        assert {k for k, r in got.items() if r.stuck} == set(range(300, 312))
        assert {k for k, r in got.items() if r.impossible} == {500, *range(10_000, 10_100)}
    assert implausible(df.limit(0), bounds).count() == 0


def test_tail_cutoff_of_an_exponential_tail():
    x = np.sort(np.random.default_rng(1).exponential(1, 200_000))
    cut = tail_cutoff(x, np.ones(len(x)), x, 0.9, 0.001)
    assert abs(cut - np.log(1000)) < 0.3
    assert tail_cutoff(np.zeros(1), np.zeros(1), np.zeros(1), 0.9, 0.05) == 0.0


def test_cutoff_stays_below_what_the_exact_check_asks():
    rng = np.random.default_rng(7)
    rules = SpikeRules()
    for draw in (rng.normal, rng.laplace, lambda m, s, n: rng.standard_t(2, n), lambda m, s, n: rng.choice([0.0, 1.0, 100.0], n, p=[0.8, 0.15, 0.05]), lambda m, s, n: rng.pareto(0.5, n)):
        r = draw(0, 1, 3000)
        scatter, _ = sp.scatter_of(binned([*sp.bins(r), sp.steps(r, 0, len(r), 1e-6)]))
        usual = np.abs(r)[np.abs(r) <= 4 * scatter]
        assert sp.cutoff_of(binned(sp.bins(usual)), scatter, rules) <= 8.5 * scatter
    with pytest.raises(ValueError):
        implausible(None, None, rules=SpikeRules(risk=0.001))


def test_method_goes_by_risk(spark):
    v = np.random.default_rng(3).normal(10, 1, 40_000)
    df = spark.createDataFrame([(i, "a", i * 60_000_000_000, float(x)) for i, x in enumerate(v)], "row_id long, tag string, ts_ns long, val double")
    bounds = spark.createDataFrame([], "tag string, phys_min double, phys_max double")
    share = {q: peaks(df, bounds, rules=SpikeRules(risk=q)).where("spike").count() / len(v) for q in (0.05, 0.0125)}
    assert all(0.8 * q < k < 1.25 * q for q, k in share.items()), share
    assert peaks(df.limit(0), bounds).count() == 0


def test_many_faults_are_found_and_a_seasonal_course_is_told(spark):
    v = np.random.default_rng(4).normal(10, 1, 3000)
    v[20:2980:12] += np.linspace(30, 90, len(v[20:2980:12]))  # 8 % of the readings, more than the risk
    rows = [(i, "a", i * 60_000_000_000, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "row_id long, tag string, ts_ns long, val double")
    bounds = spark.createDataFrame([], "tag string, phys_min double, phys_max double")
    spiky, beyond = {r.row_id for r in implausible(df, bounds).where("spike").collect()}, {r.row_id for r in peaks(df, bounds).collect()}
    assert spiky == set(range(20, 2980, 12)) and spiky < beyond
    rng = np.random.default_rng(5)
    early = np.arange(30_000) // 60 % 24 < 12  # one value a minute
    skewed = np.where(early, rng.exponential(1, 30_000), rng.normal(0.7, 1, 30_000))
    x = spark.createDataFrame([(i, "b", i * 60_000_000_000, float(y)) for i, y in enumerate(skewed)], "row_id long, tag string, ts_ns long, val double")
    kept = sp._fitted(x, bounds, "tag", "ts_ns", "val", "row_id", SpikeRules()).select("season").first().season
    assert np.mean(kept[:12]) > 0.1 > 0.05 > abs(np.mean(kept[12:]))


def test_readings_of_very_many_rows(spark):
    rows = [(i, "a", 5, 1.0) for i in range(3000)] + [(3000 + i, "a", 6 + i, float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, tag string, ts_ns long, val double")
    bounds = spark.createDataFrame([("a", 0.5, 9.0)], "tag string, phys_min double, phys_max double")
    got = {r.row_id for r in implausible(df, bounds, rules=SpikeRules(size=5)).where("impossible").collect()}
    assert got == {3000 + i for i in range(200) if i % 3 == 0}
