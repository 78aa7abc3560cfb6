import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandline.functions.quantize import effective_precision, quantize
from strandline.operators import downsample as ds
from strandline.operators.downsample import SeriesFold, downsample, fold
from strandline.operators.ingest import accepts, drop_late, evolve, guards, keep_mask, thin, zero_fill
from strandline.errors import EmptyValue, TimestampOutOfRange, UnsupportedFloat


def plain(points, end, m, mode):
    """Point by point."""
    out, last, n = [], None, 0
    for ts, v in points:
        if last is not None and ts - last < width:  # noqa: F821
            if tv is not None and v is not None:  # noqa: F821
                if mode == "avg":
                    c += 1  # noqa: F821
                    tt, tv = tt + (ts - tt) // c, tv + (v - tv) / c  # noqa: F821
                elif (mode == "min" and v < tv) or (mode == "max" and v > tv):
                    tt, tv = ts, v
            continue
        if last is not None:
            out.append((tt, tv))
        k = m - n
        if k > 0:
            width = (end - ts) // k
        if last is not None:
            n += 1
        last, tt, tv, c = ts, ts, v, 1
        if n and n >= m - 1:
            break
    return out + [(tt, tv)] if last is not None else out


POINTS = st.lists(st.tuples(st.integers(0, 400), st.none() | st.integers(-9, 9).map(float)), max_size=60).map(lambda x: sorted(x, key=lambda p: p[0]))


@settings(max_examples=400, deadline=None)
@given(POINTS, st.integers(1, 12), st.sampled_from(["avg", "min", "max", "first"]), st.integers(0, 450), st.integers(1, 9), st.sampled_from([0, 2, 40]))
def test_fold_equals_point_by_point(points, m, mode, end, part, side_by_side):
    ds.SIDE_BY_SIDE = side_by_side
    ts = np.array([p[0] for p in points], dtype=np.int64)
    v = np.array([np.nan if p[1] is None else p[1] for p in points], dtype=np.float64)
    end = max(end, int(ts[-1])) if len(ts) else end
    want = plain(points, end, m, mode if mode != "first" else "none")
    show = lambda t, x: [(int(a), None if np.isnan(b) else float(b)) for a, b in zip(t, x)]
    assert show(*fold(ts, v, end, m, mode)) == want
    f, got = SeriesFold(end, m, mode), []
    for i in range(0, len(ts), part):
        got += show(*f.feed(ts[i : i + part], v[i : i + part]))
    assert got + show(*f.close()) == want
    assert len(want) <= max(m, 2)


def test_downsample_cases(spark):
    s = 10**9
    rows = [("a", i * s, float(i), "x") for i in range(10)] + [("b", 5, None, "x"), (None, 1, 1.0, "x"), ("a", None, 1.0, "x"), ("c", 0, 7.0, "x")]
    df = spark.createDataFrame(rows, "tag string, ts_ns long, value double, until string")
    got = sorted(map(tuple, downsample(df, 1).collect()), key=str)
    assert ("b", 5, None) in got and ("c", 0, 7.0) in got and len([r for r in got if r[0] == "a"]) == 2
    assert downsample(df.limit(0), 5).count() == 0
    assert downsample(df, 5, where=F.col("value") > 1e9).count() == 0
    with pytest.raises(ValueError):
        downsample(df, -1)
    with pytest.raises(ValueError):
        downsample(df, 1, "sum")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 2)), max_size=50).map(sorted), st.integers(0, 9), st.integers(0, 9), st.integers(1, 50))
def test_kept_points(points, interval, dedup, cut):
    kept, last = [], None
    for t, c in points:
        keep = last is None or not (t - last[0] < interval or (dedup > 0 and t - last[0] <= dedup and c == last[1]))
        kept.append(keep)
        last = (t, c) if keep else last
    ts, code = (np.array([p[i] for p in points], dtype=np.int64) for i in (0, 1))
    a, state = keep_mask(ts[:cut], code[:cut], interval, dedup, None)
    b, state = keep_mask(ts[cut:], code[cut:], interval, dedup, state)
    assert [*a, *b] == kept and state == last


def test_ingest_cases(spark):
    rows = [("a", 10, 1.0), ("a", 5, 2.0), ("a", 10, 3.0), ("a", 30, float("nan")), (None, 1, 1.0), ("b", 1, None), ("b", 99, 1.0)]
    df = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)], "n long, tag string, ts_ns long, value double, _c string")
    assert {r.n for r in guards(df, 50, 10).collect()} == {0, 1, 2}
    assert {r.n for r in drop_late(df, "n", 2).collect()} == {0, 2, 3, 5, 6}
    for bad, error in (("n = 5", EmptyValue), ("n = 3", UnsupportedFloat), ("n = 6", TimestampOutOfRange)):
        with pytest.raises(error):
            guards(df.where(bad), 50, 10, strict=True)
    assert {(r.n, r._v) for r in thin(df.where("n < 3").withColumnRenamed("_c", "_v"), 0, 100, order="n").collect()} == {(1, "k"), (0, "k"), (2, "k")}
    assert thin(df.limit(0), 5, 5).count() == 0
    grown = spark.createDataFrame([((1, None, None),), (None,)], "value struct<a: long, b: string, c: struct<d: double>>")
    assert [tuple(r.value) for r in zero_fill(grown).collect()] == [(1, "", (0.0,)), (0, "", (0.0,))]
    good, odd = evolve(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), "v", "float")
    assert [r.v for r in good.collect()] == [1.0, None] and odd.count() == 1
    pairs = {("int", "int"): True, ("float", "int"): True, ("float", "bool"): True, ("int", "float"): False, ("string", "int"): False, ("bool", "string"): False}
    assert all(accepts(*k) is v for k, v in pairs.items())


def test_quantize(spark):
    df = spark.createDataFrame([(1.2345,), (1.23,), (-1.239,), (1e100,), (None,), (float("inf"),), (0.0,)], "v double")
    got = [r[0] for r in df.select(quantize(F.col("v"), 2)).collect()]
    assert got == [1.24, 1.23, -1.23, 1e100, None, float("inf"), 0.0]
    assert effective_precision(0) == 4 and effective_precision(20) == 15
    with pytest.raises(ValueError):
        effective_precision(-1)
