"""Runs of alike consecutive entries, by associative run summaries.

Entries are range-sorted by (key, time); equal (key, time) pairs stay together, and a key with most entries is cut
over many chunks. Each chunk encodes its runs on its own. What can still change are the first and the last run of a
chunk: its summary, of at most two rows. Merging the summaries of neighbouring chunks is associative: the last run of the one joins
the first of the other if they are compatible, what comes to lie inside is final, and the first and last run of both
together are the summary of the whole. So groups of ``fan`` neighbours are merged side by side, then groups of groups, until one summary is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandline.session import materialize, shuffle_width

GAP_NS = 600 * 1_000_000_000
TOLERANCE = 0.001
#: Summaries that one task merges, and bytes of distinct texts that a chunk remembers before it starts again.
FAN, KEEP_BYTES = 256, 32 << 20
#: Numbers of a text that are compared as columns of a matrix; longer ones are compared one by one.
WIDE = 16
#: Decimal texts a tolerance apart differ by it only up to the rounding of doubles.
ROUNDING = 1e-9
#: What a row of a chunk is: a run that is final, the chunk's first, its last, or its only one.
INNER, FIRST, LAST, ONLY = range(4)
_RUN = ["k", "start_ns", "end_ns", "n", "head", "tail"]
_CHUNK_SCHEMA = "part int, edge int, k long, start_ns long, end_ns long, n long, head string, tail string"


def shape_of(text: str) -> tuple[str, tuple[float, ...]]:
    """(shape, numbers) of a JSON text: equal shapes with numbers within the tolerance are alike.

    The shape has the kinds, the trimmed lower-case strings and the sorted keys; every number is cut out of it. What
    isn't JSON is a kind of its own, compared as a string.
    """
    numbers: list[float] = []

    def walk(v) -> str:
        if v is None:
            return "z"
        if isinstance(v, bool):
            return "t" if v else "f"
        if isinstance(v, (int, float)):
            try:
                numbers.append(float(v))
            except OverflowError:
                numbers.append(float("inf") if v > 0 else float("-inf"))
            return "#"
        if isinstance(v, str):
            return json.dumps(v.strip().lower())
        if isinstance(v, list):
            return "[" + ",".join(map(walk, v)) + "]"
        return "{" + ",".join(f"{json.dumps(k)}:{walk(v[k])}" for k in sorted(v)) + "}"

    try:
        shape = walk(json.loads(text))
    except (ValueError, RecursionError):
        numbers.clear()
        shape = "!" + text.strip().lower()
    return shape, tuple(numbers)


def alike(a: str, b: str, tolerance: float = TOLERANCE) -> bool:
    """Whether two JSON texts are of one kind and equal but for case, outer blanks, key order and the tolerance."""
    (sa, na), (sb, nb) = shape_of(a), shape_of(b)
    return sa == sb and _near(na, nb, tolerance)


class _Shapes:
    """Shapes as codes and numbers as a matrix; remembers what it has parsed until it is cleared."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.parsed: dict[str, tuple[int, tuple[float, ...]]] = {}
        self.used = 0

    def one(self, text: str) -> tuple[int, tuple[float, ...]]:
        x = self.parsed.get(text)
        if x is None:
            shape, numbers = shape_of(text)
            self.used += 2 * len(text) + 200
            x = self.parsed[text] = (self.codes.setdefault(shape, len(self.codes)), numbers)
        return x

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """(code of each text, its numbers up to WIDE, the distinct texts parsed, which of these each is)."""
        coded = texts.dictionary_encode()
        got = [self.one(t) for t in coded.dictionary.to_pylist()]
        width = min(WIDE, max([1, *(len(n) for _, n in got)]))
        numbers = np.zeros((len(got), width))
        for i, (_, n) in enumerate(got):
            numbers[i, : min(len(n), width)] = n[:width]
        at = coded.indices.to_numpy(zero_copy_only=False)
        return np.array([c for c, _ in got], dtype=np.int64)[at], numbers[at], got, at


def _near(a: tuple[float, ...], b: tuple[float, ...], tolerance: float) -> bool:
    return all(x == y or abs(x - y) <= tolerance + ROUNDING for x, y in zip(a, b))


def encode_chunk(batches: Iterator[pa.RecordBatch], part: int, gap_ns: int, tolerance: float, least: int) -> Iterator[pa.RecordBatch]:
    """Runs of one chunk of entries (key, time, value) in order: final ones of at least ``least`` entries, and the first and last."""
    shapes = _Shapes()
    open_run = None  # [k, start, end, n, head, tail]
    first = True
    last = None  # last entry: k, ts, text

    def row(run, edge):
        return (part, edge, *run)

    def table(rows):
        cols = list(zip(*rows))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("part", "edge", "k", "start_ns", "end_ns", "n", "head", "tail")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        ts = batch.column(1).to_numpy(zero_copy_only=False)
        texts = batch.column(2)
        if shapes.used > KEEP_BYTES:
            shapes = _Shapes()
        code, num, kinds, kind = shapes(texts)
        # one entry per (key, time): the first in order stands for all
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (ts[1:] != ts[:-1])
        if last is not None and last[0] == k[0] and last[1] == ts[0]:
            fresh[0] = False
        at = np.flatnonzero(fresh)
        if not len(at):
            continue
        k, ts, code, num, kind = k[at], ts[at], code[at], num[at], kind[at]
        joins = np.zeros(len(k), dtype=bool)
        near = np.abs(num[1:] - num[:-1]) <= tolerance + ROUNDING
        joins[1:] = (k[1:] == k[:-1]) & (ts[1:] - ts[:-1] <= gap_ns) & (code[1:] == code[:-1]) & (near | (num[1:] == num[:-1])).all(axis=1)
        if num.shape[1] == WIDE:
            for i in np.flatnonzero(joins):  # texts of more numbers than the matrix has
                if len(kinds[kind[i]][1]) > WIDE and kind[i] != kind[i - 1]:
                    joins[i] = _near(kinds[kind[i - 1]][1], kinds[kind[i]][1], tolerance)
        if last is not None and last[0] == k[0] and ts[0] - last[1] <= gap_ns:
            (c, numbers), (c0, numbers0) = shapes.one(last[2]), kinds[kind[0]]
            joins[0] = c == c0 and _near(numbers, numbers0, tolerance)
        starts = np.flatnonzero(~joins)
        text = lambda i: texts[int(at[i])].as_py()
        out = []
        lead = int(starts[0]) if len(starts) else len(k)
        if lead:  # continues the open run
            open_run[2], open_run[3], open_run[5] = int(ts[lead - 1]), open_run[3] + lead, text(lead - 1)
        ends = np.append(starts[1:], len(k)) - 1
        for j, (s, e) in enumerate(zip(starts, ends)):
            if open_run is not None:
                if first or open_run[3] >= least:
                    out.append(row(open_run, FIRST if first else INNER))
                first = False
            if j < len(starts) - 1 and not first and e - s + 1 < least:
                open_run = None  # a final run that isn't wanted
                continue
            open_run = [int(k[s]), int(ts[s]), int(ts[e]), int(e - s + 1), text(s), text(e)]
        last = (k[-1], ts[-1], text(len(k) - 1))
        if out:
            yield table(out)
    if open_run is not None:
        yield table([row(open_run, ONLY if first else LAST)])


def _encode(gap_ns: int, tolerance: float, least: int):
    return lambda batches: encode_chunk(batches, TaskContext.get().partitionId(), gap_ns, tolerance, least)


Run = tuple  # k, start_ns, end_ns, n, head, tail
Summary = tuple  # the first run and the last one, or the only run


def merge(a: Summary, b: Summary, gap_ns: int = GAP_NS, tolerance: float = TOLERANCE) -> tuple[Summary, list[Run]]:
    """The summary of two neighbouring stretches, and the runs that are final now. Associative."""
    left, right = a[-1], b[0]
    if left[0] == right[0] and right[1] - left[2] <= gap_ns and alike(left[5], right[4], tolerance):
        joined = (left[0], left[1], right[2], left[3] + right[3], left[4], right[5])
        if len(a) == 2 and len(b) == 2:
            return (a[0], b[1]), [joined]
        return (*a[:-1], joined, *b[1:]), []
    return (a[0], b[-1]), [x for x in (*a[1:], *b[:-1])]


def _merge_group(gap_ns: int, tolerance: float, fan: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, final = None, []
        for _, rows in pdf.sort_values(["part", "edge"]).groupby("part", sort=True):
            own = tuple(rows[_RUN].itertuples(index=False, name=None))
            whole, inside = (own, []) if whole is None else merge(whole, own, gap_ns, tolerance)
            final += inside
        part = int(pdf.part.iloc[0]) // fan
        edges = (ONLY,) if len(whole) == 1 else (FIRST, LAST)
        rows = [(part, INNER, *r) for r in final] + [(part, e, *r) for e, r in zip(edges, whole)]
        return pd.DataFrame(rows, columns=["part", "edge", *_RUN])

    return run


def merge_summaries(runs: DataFrame, parts: int, gap_ns: int, tolerance: float, fan: int = FAN) -> DataFrame:
    """The final runs (all as INNER) of what the chunks 0..parts-1 gave: levels of merges of ``fan`` neighbours, side by side."""
    done = [runs.where(F.col("edge") == INNER)]
    rest = runs.where(F.col("edge") != INNER)
    while True:
        got = rest.groupBy(F.floor(F.col("part") / F.lit(fan)).alias("group")).applyInPandas(_merge_group(gap_ns, tolerance, fan), _CHUNK_SCHEMA)
        parts = -(-parts // fan)
        if parts == 1:
            break
        got = materialize(got, "run-merge")
        done.append(got.where(F.col("edge") == INNER))
        rest = got.where(F.col("edge") != INNER)
    out = got
    for d in done:
        out = out.unionByName(d)
    return out


def collapse_runs(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    order: str,
    gap_ns: int = GAP_NS,
    tolerance: float = TOLERANCE,
    least: int = 1,
    chunks: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """One row per run: ``key``, ``start_ns``, ``end_ns``, ``n``, ``duration_ns``, ``val`` (the run's first value).

    Rows with null or 0 as key, null time or null value are left out; rows of one key and time count as one (the first
    by ``order``). An entry continues the run if it is at most ``gap_ns`` after the entry before and alike to it. Only
    runs of at least ``least`` entries are given. Empty input gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    chunks = chunks or shuffle_width(spark)
    rows = df.where(f"`{key}` is not null and `{key}` != 0 and `{time}` is not null and `{value}` is not null").select(
        F.col(key).cast("long").alias("k"), F.col(time).cast("long").alias("t"), F.col(value).cast("string").alias("v"), F.col(order).alias("o")
    )
    # bounds on (k, t) only: what shares a key and time is in one chunk
    chunked = rows.repartitionByRange(chunks, "k", "t").sortWithinPartitions("k", "t", "o").select("k", "t", "v")
    runs = materialize(chunked.mapInArrow(_encode(gap_ns, tolerance, least), _CHUNK_SCHEMA), "runs")
    return (
        merge_summaries(runs, chunks, gap_ns, tolerance, fan)
        .where(F.col("n") >= least)
        .select(F.col("k").alias(key), "start_ns", "end_ns", "n", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), F.col("head").alias("val"))
    )
