"""Adaptive-width downsampling of a series to a row budget.

Windows start at data points; the width of each is what remains of the time divided by what remains of the budget, so
it depends on all windows before. The chain of starts is found by binary search over the times, one step
per window; the aggregates of all windows are then folded side by side. Each series is one ordered stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.session import free_names

DEFAULT_BUDGET = 10_000
HOUR_NS = 3_600_000_000_000
MODES = ("avg", "min", "max", "first")


class SeriesFold:
    """The windows of one series, fed with ascending times in parts of any size; holds one open window.

    avg: running means of value and time. min, max: the value with its own time, the earliest of equals. first: the window's first point.
    A window that opens on a non-number (NaN) keeps it; a numeric window passes over non-numbers. Where the budget runs out,
    nothing after the first point of the last window is read.
    """

    def __init__(self, end: int, budget: int, mode: str):
        self.end, self.budget, self.mode = end, budget, mode
        self.n = 0  # windows emitted, as far as the budget counts them
        self.start: int | None = None  # of the open window
        self.width = 0
        self.state = (0, 0.0, 0)  # its time, value, and number of points
        self.full = False

    def _open(self, at: int) -> None:
        left = self.budget - self.n
        if left > 0:
            self.width = (self.end - at) // left
        if self.start is not None:
            self.n += 1
            self.full = self.n >= self.budget - 1
        self.start = at

    def feed(self, ts: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times, values) of the windows that these points close."""
        if self.full or not len(ts):
            return ts[:0], v[:0]
        carried = self.start is not None
        starts: list[int] = []
        i = int(np.searchsorted(ts, self.start + self.width, side="left")) if carried else 0
        while i < len(ts) and not self.full:
            self._open(int(ts[i]))
            starts.append(i)
            i = max(i + 1, int(np.searchsorted(ts, self.start + self.width, side="left")))
        at = np.array(starts, dtype=np.int64)
        begin, tt, tv = at + 1, ts[at], v[at]
        c = np.ones(len(at), dtype=np.int64)
        stop = np.append(at[1:], begin[-1] if self.full else len(ts)) if len(at) else at
        if carried:
            begin, stop = np.append(0, begin), np.append(at[0] if len(at) else len(ts), stop)
            tt, tv, c = np.append(self.state[0], tt), np.append(self.state[1], tv), np.append(self.state[2], c)
        tt, tv = tt.astype(np.int64), tv.astype(np.float64)
        if self.mode != "first":
            self._aggregate(ts, v, begin, stop, tt, tv, c)
        self.state = (int(tt[-1]), float(tv[-1]), int(c[-1]))
        return tt[:-1], tv[:-1]

    def _aggregate(self, ts, v, begin, stop, tt, tv, c) -> None:
        size, live = stop - begin, ~np.isnan(tv)
        live &= size > 0
        if self.mode == "avg":
            _means(ts, v, begin, size, live, tt, tv, c)
        elif live.any():
            _extremes(ts, v if self.mode == "min" else -v, begin, stop, live, tt, tv, 1 if self.mode == "min" else -1)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """The window left open."""
        some = self.start is not None
        return np.array([self.state[0]] * some, dtype=np.int64), np.array([self.state[1]] * some, dtype=np.float64)


#: Points per window on average from which a window's means are run through one after the other.
SIDE_BY_SIDE = 40


def _means(ts, v, begin, size, live, tt, tv, c) -> None:
    """Running means of the windows, each in the order of its points, since the order decides the last bits.

    Many short windows go side by side: first their first points, then their second ones, and so on. Long ones go one by one.
    """
    if size[live].sum() < SIDE_BY_SIDE * max(int(size[live].max(initial=0)), 1) or len(size) == 1:
        for i in np.flatnonzero(live):
            a, z = begin[i], begin[i] + size[i]
            x = v[a:z]
            ok = ~np.isnan(x)
            n, mean, at = int(c[i]), float(tv[i]), int(tt[i])
            for y, t in zip(x[ok].tolist(), ts[a:z][ok].tolist()):
                n += 1
                at += (t - at) // n
                mean += (y - mean) / n
            c[i], tv[i], tt[i] = n, mean, at
        return
    for j in range(int(size[live].max(initial=0))):
        on = np.flatnonzero((size > j) & live)
        x, t = v[begin[on] + j], ts[begin[on] + j]
        ok = ~np.isnan(x)
        on, x, t = on[ok], x[ok], t[ok]
        c[on] += 1
        tt[on] += (t - tt[on]) // c[on]
        tv[on] += (x - tv[on]) / c[on]


def _extremes(ts, x, begin, stop, live, tt, tv, sign) -> None:
    """The least of each window, with the time of the first such point, where it is below what the window has."""
    on = np.flatnonzero(live)
    padded = np.append(np.where(np.isnan(x), np.inf, x), np.inf)
    least = np.minimum.reduceat(padded, np.stack([begin[on], stop[on]], axis=1).ravel())[::2]
    better = least < sign * tv[on]
    on, least = on[better], least[better]
    if not len(on):
        return
    size = stop[on] - begin[on]
    window = np.repeat(np.arange(len(on)), size)
    at = np.arange(size.sum()) + np.repeat(begin[on] - np.cumsum(size) + size, size)
    hits = np.flatnonzero(padded[at] == least[window])
    _, first = np.unique(window[hits], return_index=True)
    tt[on], tv[on] = ts[at[hits[first]]], sign * least


def fold(ts: np.ndarray, v: np.ndarray, end: int, budget: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """(times, values) of the windows of one whole series."""
    f = SeriesFold(end, budget, mode)
    (t, x), (t1, x1) = f.feed(ts, v), f.close()
    return np.append(t, t1), np.append(x, x1)


def pieces(tags: pa.Array) -> Iterator[tuple[str, int, int]]:
    """(tag, from, to) of each run of one tag."""
    coded = tags.dictionary_encode()
    at, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    edges = (np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()
    for a, z in zip([0, *edges], [*edges, len(at)]):
        yield names[at[a]], a, z


def _streams(budget: int, mode: str):
    """Over partitions sorted by (tag, ts, order): one series after the other, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, series = None, None

        def rows(tag, got):
            return pa.RecordBatch.from_arrays([pa.array([tag] * len(got[0]), pa.string()), pa.array(got[0]), pa.array(got[1], from_pandas=True)], names=["tag", "ts_ns", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ts, v, until = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for name, a, z in pieces(batch.column(0)):
                if series is None or name != tag:
                    if series is not None:
                        yield rows(tag, series.close())
                    tag, series = name, SeriesFold(int(until[a]), budget, mode)
                yield rows(tag, series.feed(ts[a:z], v[a:z]))
        if series is not None:
            yield rows(tag, series.close())

    return run


def downsample(
    series: DataFrame,
    budget: int = 0,
    mode: str = "avg",
    start: int | None = None,
    end: int | None = None,
    where=None,
    order: str | None = None,
    newest: DataFrame | None = None,
) -> DataFrame:
    """(tag, ts_ns, value): every series of ``series`` (tag, ts_ns, value, and ``order`` to break ties) within the budget.

    ``start`` and ``end`` are inclusive. The span is cut at the tag's newest point, taken before range and predicate, as the
    windows' widths depend on it; ``newest`` (tag, until) has it for all tags if it is known, and saves a pass over the series. ``where`` is a boolean Column or SQL text. ``budget`` 0 is DEFAULT_BUDGET, negative raises. Null tags
    and times are left out; a null or NaN value is no number. Empty input gives no rows.
    """
    if budget < 0:
        raise ValueError("budget must not be negative")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    budget = budget or DEFAULT_BUDGET
    rows = series.where("tag is not null and ts_ns is not null")
    if newest is None:
        newest = rows.groupBy("tag").agg(F.max("ts_ns").alias("until"))
    if end is not None:
        newest = newest.withColumn("until", F.least("until", F.lit(end).cast("long")))
        rows = rows.where(F.col("ts_ns") <= end)
    if start is not None:
        rows = rows.where(F.col("ts_ns") >= start)
    if where is not None:
        rows = rows.where(where)
    picked = rows.select("tag", F.col("ts_ns").cast("long"), F.col("value").cast("double"), *([F.col(order).alias("o")] if order else []))
    joined = picked.join(newest, "tag").repartition("tag").sortWithinPartitions("tag", "ts_ns", *(["o"] if order else []))
    return joined.select("tag", "ts_ns", "value", "until").mapInArrow(_streams(budget, mode), "tag string, ts_ns long, value double")


def downsample_first(
    series: DataFrame, budget: int = 0, order: str | None = None, start: int | None = None, end: int | None = None, where=None, newest: DataFrame | None = None
) -> DataFrame:
    """The first row of each window, with all columns: what downsampling does to values that are no numbers.

    Ties of (tag, ts_ns) without ``order`` give one of the rows. Only keys go through the window chain; the rows are joined to it."""
    rows = series if where is None else series.where(where)
    if newest is None:
        newest = series.where("tag is not null").groupBy("tag").agg(F.max("ts_ns").alias("until"))
    keys = rows.select("tag", "ts_ns").withColumn("value", F.lit(None).cast("double"))
    starts = downsample(keys, budget, "first", start, end, newest=newest).select("tag", "ts_ns").distinct()
    return _first_of(rows.join(starts, ["tag", "ts_ns"]), order)


def _first_of(rows: DataFrame, order: str | None) -> DataFrame:
    pick = Window.partitionBy("tag", "ts_ns").orderBy(order or "ts_ns")
    n = free_names(rows, "_n")[0]
    return rows.withColumn(n, F.row_number().over(pick)).where(F.col(n) == 1).drop(n)


def downsample_adaptive(
    series: DataFrame,
    budget: int = 0,
    mode: str = "avg",
    start: int | None = None,
    end: int | None = None,
    where=None,
    order: str | None = None,
    newest: DataFrame | None = None,
) -> DataFrame:
    """(tag, ts_ns, value): as ``downsample`` of a series of variants, value by value.

    A window that opens on a number aggregates the numbers in it, as a double, and passes over all else; one that opens on anything else keeps that
    value. Booleans and texts are no numbers.
    """
    kind = F.schema_of_variant("value")
    number = F.when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get("value", "$", "double"))
    rows = series if where is None else series.where(where)
    if newest is None:
        newest = series.where("tag is not null").groupBy("tag").agg(F.max("ts_ns").alias("until"))
    got = downsample(rows.withColumn("value", number), budget, mode, start, end, None, order, newest)
    # windows that opened on no number: the values that they opened on
    opened = got.where("value is null").select("tag", "ts_ns").distinct()
    others = _first_of(rows.join(opened, ["tag", "ts_ns"]), order).select("tag", "ts_ns", "value")
    return got.where("value is not null").withColumn("value", F.col("value").cast("variant")).unionByName(others)
