"""Implausible readings per source: spikes, stuck values, physically impossible values.

Readings are range-sorted by (source, time) and cut into chunks of so many readings, each with the readings just before and after it, so that a
source with most rows is spread over many tasks and no chunk grows with the rate of a source. The residual of a reading is its distance from
the source's running level (a centred median, which follows trends and permanent changes of level); its seasonal residual is what is left of that after the source's
usual residual at that hour of the day. Magnitudes are summed up in mergeable histograms, from which peaks-over-threshold fits a generalised Pareto tail per source;
its quantile at a fixed risk is the source's cutoff. ``peaks`` gives what lies beyond it, with the stuck-duration and plausibility rules. ``implausible`` takes the same
readings as candidates and confirms those that leave the level by more than nine times the usual scatter and return.

No such reading can fail to be a candidate. The tail is fitted to the readings within four scatters s, so the threshold u is at most 4 s and the mean excess m at
most 4 s - u. With k = (1 - threshold) / risk = 8 and a shape x within -1..0.5 the cutoff is u + m (1 - x) (k^x - 1) / x <= u + 2.09 m <= 8.36 s. The seasonal part is held
within half a scatter, so that nine scatters of residual are at least 8.5 of seasonal residual.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strandline.session import materialize, shuffle_width


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the rules.

    ``size``: readings of a chunk. ``half``: readings on either side in the running median. ``threshold``: share of the usual
    readings below the peaks' threshold. ``risk``: share of the usual readings beyond the fitted cutoff; (1 - threshold) / risk is at most 8.
    ``usual``: scatters within which readings are usual. ``season``: scatters that the seasonal part amounts to at most.
    ``times``: usual scatters that a spike leaves its level by. ``longest``: readings of a spike at most. ``stuck``: readings
    of a stuck run at least. ``beside``: readings on either side that tell the levels it leaves and returns to. ``still``: largest step of a value that stands still.
    """

    size: int = 20_000
    half: int = 10
    threshold: float = 0.90
    risk: float = 0.0125
    usual: float = 4.0
    season: float = 0.5
    times: float = 9.0
    longest: int = 3
    stuck: int = 12
    beside: int = 8
    still: float = 0.000001

    @property
    def halo(self) -> int:
        return max(self.half, self.beside, self.stuck - self.longest) + self.longest + 2


#: Bins of residual magnitude per doubling; the key of the exact zeros and of the counts of steps.
PER_OCTAVE, ZERO_BIN, STEP_BIN = 32, -1_000_000, 1_000_000
#: Hours of the day that the seasonal part is told for, and the shapes that a tail may have.
HOURS, HOUR_NS, SHAPES = 24, 3_600_000_000_000, (-1.0, 0.5)
#: Infinite readings take part as the largest magnitude that squares without overflow.
LARGEST = 1e150


def running_level(v: np.ndarray, half: int) -> np.ndarray:
    """Centred running median; at the ends over what there is."""
    n = len(v)
    if n <= 2 * half:
        return np.array([np.median(v[max(0, i - half) : i + half + 1]) for i in range(n)])
    out = np.empty(n)
    out[half : n - half] = np.median(np.lib.stride_tricks.sliding_window_view(v, 2 * half + 1), axis=1)
    for i in range(half):
        out[i] = np.median(v[: i + half + 1])
        out[n - 1 - i] = np.median(v[n - 1 - i - half :])
    return out


def tail_cutoff(edge: np.ndarray, n: np.ndarray, total: np.ndarray, threshold: float, risk: float, most: float = np.inf) -> float:
    """Cutoff that a share ``risk`` of the readings lies beyond, by a generalised Pareto fit (probability-weighted moments) to the peaks over the
    ``threshold`` quantile. Per bin, ascending: its upper ``edge``, the number of magnitudes in it and their ``total``; none is above ``most``.
    """
    count = n.sum()
    if not count:
        return 0.0
    at = min(int(np.searchsorted(np.cumsum(n), threshold * count)), len(edge) - 1)
    u = min(float(edge[at]), most)
    over = np.arange(len(edge)) > at
    k = float(n[over].sum())
    if k < 5 or risk >= k / count:
        return u
    x = np.maximum(total[over] / n[over] - u, 0)
    mean = float((x * n[over]).sum() / k)
    if mean <= 0:
        return u
    above = 1 - (np.cumsum(n[over]) - n[over] / 2) / k
    weighted = float((x * above * n[over]).sum() / k)
    shape = 2 - mean / (mean - 2 * weighted) if mean > 2 * weighted else SHAPES[1]
    shape = float(np.clip(shape, *SHAPES))
    beyond = k / count / risk
    return u + mean * (float(np.log(beyond)) if abs(shape) < 1e-9 else (1 - shape) * (beyond**shape - 1) / shape)


def usual_scatter(magnitude: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> float:
    """Standard deviation of the residuals within four of it, from binned sums; starts from the median magnitude."""
    total = n.sum()
    if not total:
        return 0.0
    mid = 1.4826 * float(magnitude[int(np.searchsorted(np.cumsum(n), 0.5 * total))])
    scale = mid
    for _ in range(6):
        inside = magnitude <= 4 * scale
        m = n[inside].sum()
        if not m:
            return mid
        scale = float(np.sqrt(max(0.0, s2[inside].sum() / m - (s1[inside].sum() / m) ** 2)))
    return scale


def _chunks(df: DataFrame, tag: str, time: str, value: str, row: str, rules: SpikeRules) -> DataFrame:
    rows = df.where(f"`{tag}` is not null and `{value}` is not null and not isnan(`{value}`) and `{time}` is not null").select(
        F.col(tag).cast("string").alias("tag"), F.col(time).cast("long").alias("ts"), F.col(row).cast("long").alias("row"), F.col(value).cast("double").alias("val")
    )
    # bounds on (tag, ts) only: rows of one reading are in one partition
    laid = rows.repartitionByRange(shuffle_width(df.sparkSession), "tag", "ts").sortWithinPartitions("tag", "ts", "row")
    packed = "tag string, part int, nth int, v binary, hour binary, ids binary, of binary, head binary, tail binary"
    return materialize(laid.mapInArrow(_pack(rules), packed), "chunks")


def _pack(rules: SpikeRules):
    """Readings of a chunk as packed arrays: value (of the first row) and hour of each distinct time, and per row its reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, tag, held, most = TaskContext.get().partitionId(), 0, None, [], 0

        def chunk(ts, ids, val):
            nonlocal nth
            fresh = np.r_[True, ts[1:] != ts[:-1]]
            v, of = np.clip(val[fresh], -LARGEST, LARGEST), (np.cumsum(fresh) - 1).astype(np.int32)
            hour = (ts[fresh] // HOUR_NS % HOURS).astype(np.int8)
            arrays = [x.tobytes() for x in (v, hour, ids, of, v[: rules.halo], v[-rules.halo :])]
            nth += 1
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            names = ["tag", "part", "nth", "v", "hour", "ids", "of", "head", "tail"]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([tag, part, nth, *arrays], kinds)], names=names)

        def cut(last: bool):
            """Chunks of what is held; the rest of it stays, unless it is the ``last`` of its source."""
            nonlocal held
            ts, ids, val = (np.concatenate(x) for x in zip(*held))
            first = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])  # of each reading
            ends = first[rules.size :: rules.size].tolist()
            if last:
                ends.append(len(ts))
            a = 0
            for z in ends:
                yield chunk(ts[a:z], ids[a:z], val[a:z])
                a = z
            held = [(ts[a:], ids[a:], val[a:])]

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            at, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            edges = np.flatnonzero(at[1:] != at[:-1]) + 1
            for a, z in zip([0, *edges], [*edges, len(at)]):
                if names[at[a]] != tag:
                    if held:
                        yield from cut(True)
                    tag, held = names[at[a]], []
                held.append(tuple(c[a:z] for c in cols))
            if sum(len(x[0]) for x in held) > max(most, 2 * rules.size):
                yield from cut(False)
                most = 2 * len(held[0][0])  # more only where very many rows are one reading
        if held:
            yield from cut(True)

    return run


def _joined(halo: int, before, v: bytes, after) -> tuple[np.ndarray, int, int]:
    a = np.frombuffer(b"".join(before), dtype=np.float64)[-halo:] if before is not None and len(before) else np.empty(0)
    z = np.frombuffer(b"".join(after), dtype=np.float64)[:halo] if after is not None and len(after) else np.empty(0)
    x = np.frombuffer(v, dtype=np.float64)
    return np.concatenate([a, x, z]), len(a), len(x)


def _residuals(rules: SpikeRules):
    """Of each chunk with its halos: values, residuals, where its own readings begin and how many they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for before, v, after in pdf[["before", "v", "after"]].itertuples(index=False):
                x, a, n = _joined(rules.halo, before, v, after)
                out.append((x.tobytes(), (x - running_level(x, rules.half)).tobytes(), a, n))
            kept = pdf[["tag", "hour", "ids", "of"]].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame(out, columns=["x", "r", "a", "n"])], axis=1)

    return run


def _own(r: bytes, a: int, n: int) -> np.ndarray:
    return np.frombuffer(r, dtype=np.float64)[a : a + n]


def bins(r: np.ndarray) -> list[tuple[int, float, float, float, float]]:
    """(bin, number, sum, sum of magnitudes, sum of squares) of residuals by their magnitude."""
    m = np.abs(r)
    key = np.full(len(m), ZERO_BIN)
    key[m > 0] = np.floor(np.log2(m[m > 0]) * PER_OCTAVE)
    got, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    return list(zip(got.tolist(), cnt.astype(float), np.bincount(inv, r), np.bincount(inv, m), np.bincount(inv, r * r)))


def steps(x: np.ndarray, a: int, n: int, still: float) -> tuple[int, float, float, float, float]:
    """The row of a histogram that counts the steps to a chunk's readings, and those that stand still."""
    step = np.abs(np.diff(x[max(0, a - 1) : a + n]))
    return STEP_BIN, float(len(step)), float((step <= still).sum()), 0.0, 0.0


_BINS = "tag string, bin long, n double, s double, m double, q double"


def _edges(bins: pd.DataFrame) -> np.ndarray:
    return np.where(bins.bin == ZERO_BIN, 0.0, 2.0 ** ((bins.bin.to_numpy(dtype=float) + 1) / PER_OCTAVE))


def _counted(rules: SpikeRules):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for tag, x, r, a, n in pdf[["tag", "x", "r", "a", "n"]].itertuples(index=False):
                out += [(tag, *b) for b in bins(_own(r, a, n))]
                out.append((tag, *steps(np.frombuffer(x, dtype=np.float64), a, n, rules.still)))
            yield pd.DataFrame(out, columns=["tag", "bin", "n", "s", "m", "q"])

    return run


def scatter_of(pdf: pd.DataFrame) -> tuple[float, float]:
    """(usual scatter, share of steps that stand still) of a source's histogram."""
    pdf = pdf.sort_values("bin")
    moves, own = pdf[pdf.bin == STEP_BIN], pdf[pdf.bin != STEP_BIN]
    n, s, q = (own[c].to_numpy(dtype=float) for c in ("n", "s", "q"))
    return usual_scatter(_edges(own), n, s, q), float(moves.s.sum() / moves.n.sum()) if moves.n.sum() else 0.0


def hourly(r: np.ndarray, hour: np.ndarray, scatter: float, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray]:
    """(number, sum) of the usual residuals at each hour of the day."""
    usual = np.abs(r) <= rules.usual * scatter
    return np.bincount(hour[usual], minlength=HOURS).astype(float), np.bincount(hour[usual], r[usual], minlength=HOURS)


def season_of(n: np.ndarray, s: np.ndarray, scatter: float, rules: SpikeRules) -> np.ndarray:
    return np.clip(s / np.maximum(n, 1), -rules.season * scatter, rules.season * scatter)


def _seasons(rules: SpikeRules):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            acc: dict[str, np.ndarray] = {}
            for tag, r, a, n, hour, scatter in pdf[["tag", "r", "a", "n", "hour", "scatter"]].itertuples(index=False):
                got = np.stack(hourly(_own(r, a, n), np.frombuffer(hour, dtype=np.int8), scatter, rules))
                acc[tag] = acc[tag] + got if tag in acc else got
            rows = [(t, h, x[0, h], x[1, h]) for t, x in acc.items() for h in range(HOURS) if x[0, h]]
            yield pd.DataFrame(rows, columns=["tag", "hour", "n", "s"])

    return run


def seasonal(r: np.ndarray, hour: np.ndarray, season: np.ndarray) -> np.ndarray:
    """Magnitudes of the seasonal residuals."""
    return np.abs(r - season[hour])


def _usual_peaks(rules: SpikeRules):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for tag, r, a, n, hour, scatter, season in pdf[["tag", "r", "a", "n", "hour", "scatter", "season"]].itertuples(index=False):
                size = seasonal(_own(r, a, n), np.frombuffer(hour, dtype=np.int8), np.asarray(season))
                out += [(tag, *b) for b in bins(size[size <= rules.usual * scatter])]
            yield pd.DataFrame(out, columns=["tag", "bin", "n", "s", "m", "q"])

    return run


def cutoff_of(pdf: pd.DataFrame, scatter: float, rules: SpikeRules) -> float:
    """The cutoff of a source from the histogram of its usual seasonal residuals."""
    pdf = pdf.sort_values("bin")
    return tail_cutoff(_edges(pdf), pdf.n.to_numpy(dtype=float), pdf.m.to_numpy(dtype=float), rules.threshold, rules.risk, rules.usual * scatter)


def _per_source(df: DataFrame, run, schema: str) -> DataFrame:
    """Histograms are summed first, so a source has at most some 60,000 rows of bins, however many readings it has."""
    sums = df.groupBy("tag", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "m", "q")])
    return sums.groupBy("tag").applyInPandas(run, schema)


def _run_lengths(on: np.ndarray) -> np.ndarray:
    """Length of the run of Trues that each True belongs to; 0 elsewhere."""
    out = np.zeros(len(on), dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
    for s, e in zip(edge[::2], edge[1::2]):
        out[s:e] = e - s
    return out


def spike_flags(x: np.ndarray, r: np.ndarray, candidate: np.ndarray, rules: SpikeRules, scatter: float) -> np.ndarray:
    """Of the ``candidate`` readings those that, at most ``longest`` in a row, are beyond ``times`` scatters, and so on the same side of the levels before and after."""
    over = candidate.copy()
    over[over] = (r[over] > rules.times * scatter) & (r[over] > rules.still)
    if not over.any():
        return over
    length = _run_lengths(over)
    hit = (length > 0) & (length <= rules.longest)
    if len(x):
        for end, step in ((0, 1), (len(x) - 1, -1)):  # doesn't return, or had no level to leave, within the series
            i = end
            while 0 <= i < len(x) and over[i]:
                hit[i] = False
                i += step
    # a reading on the way from one level to another lies between them; a spike is beyond both
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    for a, z in zip(edge[::2], edge[1::2]):
        off = x[a:z, None] - [np.median(x[max(0, a - rules.beside) : a]), np.median(x[z : z + rules.beside])]
        if not ((np.abs(off) > rules.times * scatter).all() and (off[:, 0] * off[:, 1] > 0).all()):
            hit[a:z] = False
    return hit


def stuck_flags(x: np.ndarray, rules: SpikeRules) -> np.ndarray:
    steps = np.abs(np.diff(x)) <= rules.still
    edge = np.flatnonzero(np.diff(np.r_[0, steps.astype(np.int8), 0]))
    hit = np.zeros(len(x), dtype=bool)
    for s, e in zip(edge[::2], edge[1::2]):
        if e - s + 1 >= rules.stuck:
            hit[s : e + 1] = True
    return hit


def _flag(rules: SpikeRules, confirm: bool):
    """Rows with a flag; what is beyond the cutoff is a spike as such, or if the exact check confirms it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tag", "x", "r", "a", "n", "hour", "ids", "of", "scatter", "still_share", "season", "cutoff", "phys_min", "phys_max"]
        for pdf in frames:
            parts = []
            for tag, x, r, a, n, hour, ids, of, scatter, still, season, cutoff, low, high in pdf[names].itertuples(index=False):
                x, r = (np.frombuffer(b, dtype=np.float64) for b in (x, r))
                cut = slice(a, a + n)
                size = seasonal(r[cut], np.frombuffer(hour, dtype=np.int8), np.asarray(season))
                spike = size > cutoff
                if confirm and spike.any():
                    near = np.ones(len(x), dtype=bool)  # the halo belongs to other chunks, where its readings are candidates
                    near[cut] = spike
                    spike = spike_flags(x, np.abs(r), near, rules, scatter)[cut]
                stuck = stuck_flags(x, rules)[cut] if still < 0.5 else np.zeros(n, dtype=bool)
                own = x[cut]
                out = np.zeros(n, dtype=bool)
                if low is not None and low == low:
                    out |= own < low
                if high is not None and high == high:
                    out |= own > high
                of = np.frombuffer(of, dtype=np.int32)
                hit = np.flatnonzero((spike | stuck | out)[of])
                if len(hit):
                    at = of[hit]
                    rows = {"row_id": np.frombuffer(ids, dtype=np.int64)[hit], "tag": tag, "impossible": out[at], "stuck": stuck[at], "spike": spike[at]}
                    parts.append(pd.DataFrame({**rows, "residual": size[at], "cutoff": cutoff}))
            if parts:
                yield pd.concat(parts)

    return run


def _fitted(df: DataFrame, bounds: DataFrame, tag: str, time: str, value: str, row: str, rules: SpikeRules) -> DataFrame:
    """Chunks with residuals, and with scatter, season, cutoff, share of steps that stand still, and bounds of their source."""
    if (1 - rules.threshold) / rules.risk > 8.0001 or rules.times < 9 or rules.usual > 4 or rules.season > 0.5:
        raise ValueError("with these rules a spike might not be beyond the cutoff")
    chunks = _chunks(df, tag, time, value, row, rules)
    order = Window.partitionBy("tag").orderBy("part", "nth")
    # a chunk has at least one reading, so as many chunks as the halo has readings hold the halo
    halos = chunks.select(
        "tag", "part", "nth",
        F.collect_list("tail").over(order.rowsBetween(-rules.halo, -1)).alias("before"),
        F.collect_list("head").over(order.rowsBetween(1, rules.halo)).alias("after"),
    )
    full = chunks.drop("head", "tail").join(halos, ["tag", "part", "nth"])
    kept = "tag string, hour binary, ids binary, of binary, x binary, r binary, a int, n int"
    whole = materialize(full.mapInPandas(_residuals(rules), kept), "residuals")

    def scatters(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf.tag.iloc[0], *scatter_of(pdf))], columns=["tag", "scatter", "still_share"])

    def cutoffs(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf.tag.iloc[0], cutoff_of(pdf, float(pdf.scatter.iloc[0]), rules))], columns=["tag", "cutoff"])

    # statistics are written, so that their size is known where they are joined: small ones are broadcast, others not
    counted = whole.select("tag", "x", "r", "a", "n").mapInPandas(_counted(rules), _BINS)
    stats = materialize(_per_source(counted, scatters, "tag string, scatter double, still_share double"), "scatters")
    hours = whole.select("tag", "r", "a", "n", "hour").join(stats, "tag").mapInPandas(_seasons(rules), "tag string, hour int, n double, s double")
    sums = hours.groupBy("tag", "hour").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(stats, "tag")
    part = F.greatest(F.least(F.col("s") / F.col("n"), rules.season * F.col("scatter")), -rules.season * F.col("scatter"))
    season = sums.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("hour", part.alias("p")))).alias("m"))  # at most 24 entries
    by_hour = F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    stats = materialize(stats.join(season, "tag", "left").withColumn("season", F.coalesce(by_hour, F.array(*[F.lit(0.0)] * HOURS))).drop("m"), "seasons")
    peaked = whole.select("tag", "r", "a", "n", "hour").join(stats, "tag").mapInPandas(_usual_peaks(rules), _BINS)
    sized = peaked.groupBy("tag", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "m", "q")]).join(stats.select("tag", "scatter"), "tag")
    cutoff = sized.groupBy("tag").applyInPandas(cutoffs, "tag string, cutoff double")
    limits = bounds.where("tag is not null").groupBy("tag").agg(F.min("phys_min").alias("phys_min"), F.max("phys_max").alias("phys_max"))
    stats = materialize(stats.join(cutoff, "tag", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(0.0))).join(limits, "tag", "left"), "cutoffs")
    return whole.join(stats, "tag")


_FLAGS = "row_id long, tag string, impossible boolean, stuck boolean, spike boolean, residual double, cutoff double"


def implausible(
    df: DataFrame,
    bounds: DataFrame,
    tag: str = "tag",
    time: str = "ts_ns",
    value: str = "val",
    row: str = "row_id",
    rules: SpikeRules = SpikeRules(),
) -> DataFrame:
    """(``row_id``, ``tag``, ``impossible``, ``stuck``, ``spike``) of every row with at least one flag.

    A spike is a reading beyond its source's fitted cutoff that the exact check confirms: at most ``longest`` in a row that leave the level around them by more than
    ``times`` usual scatters and return. ``bounds`` has ``tag``, ``phys_min``, ``phys_max``; null bounds, and tags that aren't in it, are unbounded. Rows with null tag, time or
    value, and NaN values, are left out; infinite values take part as very large ones. Rows of one tag and time are one
    reading, that of the smallest row id; all of them get its flags. A departure at the very start or end of a
    source isn't a spike, since it doesn't leave or doesn't return. Empty input gives no rows.
    """
    return _fitted(df, bounds, tag, time, value, row, rules).mapInPandas(_flag(rules, True), _FLAGS).drop("residual", "cutoff")


def peaks(
    df: DataFrame, bounds: DataFrame, tag: str = "tag", time: str = "ts_ns", value: str = "val", row: str = "row_id", rules: SpikeRules = SpikeRules()
) -> DataFrame:
    """(``row_id``, ``tag``, ``impossible``, ``stuck``, ``spike``, ``residual``, ``cutoff``) of every row with at least one flag, where a spike is every reading
    whose seasonal ``residual`` is beyond the ``cutoff`` fitted for its source.

    That is about a share ``risk`` of the usual rows of a source, whether faulty or not, and what is faulty besides. The same rows are left out and taken for one reading as
    by ``implausible``. Empty input gives no rows.
    """
    return _fitted(df, bounds, tag, time, value, row, rules).mapInPandas(_flag(rules, False), _FLAGS)
