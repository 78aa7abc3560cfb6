"""Percentiles per group by radix selection over order-preserving integers.

A double becomes a 64-bit integer of the same order. A first histogram counts its leading bits per group; for each
wanted rank only the digit that holds it is followed by the next, finer histogram, until all bits are known (exact)
or as far as asked (bounded error). Histograms of the first digit are also kept per group and day as summaries: adding
them up gives the summary of any span, and percentiles whose error is bounded by the width of a digit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strandline.session import materialize

#: Bits per pass. The first 20 are sign, exponent and 8 bits of mantissa: a relative width of 2**-8.
DIGITS = (20, 22, 22)
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """int64 with the order of the (non-NaN) doubles; -0.0 becomes 0.0."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _FLIP, bits)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, dtype=np.int64)
    return np.where(bits < 0, bits ^ _FLIP, bits).view(np.float64)


@F.pandas_udf(T.LongType())
def _to_bits(v: pd.Series) -> pd.Series:
    return pd.Series(ordered_bits(v.to_numpy()))


@F.pandas_udf(T.DoubleType())
def _to_value(bits: pd.Series) -> pd.Series:
    return pd.Series(from_ordered_bits(bits.to_numpy()))


def _finite(df: DataFrame, group: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.where(
        F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    ).select(F.col(group).alias("g"), *extra, _to_bits(F.col(value).cast("double")).alias("key"))


def _digit(key, upto: int):
    """The leading ``upto`` bits of the biased key, as a signed prefix that keeps the order."""
    return F.shiftright(key, 64 - upto) if upto < 64 else key


def day_summaries(df: DataFrame, group: str, value: str, day: str, bits: int = DIGITS[0]) -> DataFrame:
    """Mergeable summaries: (``group``, ``day``, ``digit``, ``n``), one row per populated digit. Null groups, and null
    or non-finite values, are left out; a null day is a day of its own. Empty input gives none."""
    rows = _finite(df, group, value, [F.col(day).alias("d")])
    out = rows.groupBy("g", "d", _digit(F.col("key"), bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("g").alias(group), F.col("d").alias(day), "digit", "n")


def percentiles_from_summaries(
    summaries: DataFrame, group: str, probs: Sequence[float], bits: int = DIGITS[0]
) -> DataFrame:
    """(``group``, ``q``, ``n``, ``low``, ``high``): bounds of each percentile from any union of summaries.

    The percentile (nearest rank) lies in ``low``..``high``, one digit wide. Adding summaries is associative, so parts
    may come from any partitions or days.
    """
    hist = summaries.groupBy(F.col(group).alias("g"), F.lit(0).cast("long").alias("prefix"), "digit").agg(F.sum("n").alias("n"))
    targets = _targets(hist.groupBy("g").agg(F.sum("n").alias("n")), probs)
    return _bounds(_follow(hist, targets), bits, group)


def _targets(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    q = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    rank = F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("n")).cast("double")).cast("long")
    return counts.select("g", "n", q).select("g", "q", F.col("n").alias("total"), rank.alias("rank"), F.lit(0).cast("long").alias("prefix"))


def _follow(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's next prefix: the digit that holds its rank. ``digit`` is the whole prefix so far."""
    run = Window.partitionBy("g", "prefix").orderBy("digit")
    cum = hist.withColumn("upto", F.sum("n").over(run)).select("g", "prefix", "digit", F.col("n").alias("here"), "upto")
    hit = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("here"))
    return (
        targets.join(cum, ["g", "prefix"])
        .where(hit)
        .select("g", "q", "total", (F.col("rank") - (F.col("upto") - F.col("here"))).alias("rank"), F.col("digit").alias("prefix"))
    )


def _bounds(found: DataFrame, bits: int, group: str) -> DataFrame:
    low = F.shiftleft(F.col("prefix"), 64 - bits) if bits < 64 else F.col("prefix")
    high = low.bitwiseOR(F.lit((1 << (64 - bits)) - 1)) if bits < 64 else low
    return found.select(
        F.col("g").alias(group), "q", F.col("total").alias("n"), _to_value(low).alias("low"), _to_value(high).alias("high")
    )


def radix_percentiles(
    df: DataFrame, group: str, value: str, probs: Sequence[float], digits: Sequence[int] = DIGITS
) -> DataFrame:
    """(``group``, ``q``, ``n``, ``low``, ``high``): per group the nearest-rank percentiles (rank ceil(q n), at least 1).

    With digits that add up to 64 bits ``low`` = ``high`` is the exact value; with fewer it lies between them. Null
    groups, null and non-finite values are left out, a group without values has no rows, and ties and repeated rows
    count each. Values move once, as 8-byte keys; each pass counts map-side and shuffles only counts, so a group with
    most rows is no bottleneck.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must be within 0..1")
    if not digits or sum(digits) > 64:
        raise ValueError("digits must add up to at most 64 bits")
    keyed = materialize(_finite(df, group, value), "radix")
    targets, done = None, 0
    for width in digits:
        upto = done + width
        rows = keyed.select("g", _digit(F.col("key"), done).alias("prefix") if done else F.lit(0).cast("long").alias("prefix"), _digit(F.col("key"), upto).alias("digit"))
        if targets is not None:
            rows = rows.join(targets.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        hist = rows.groupBy("g", "prefix", "digit").agg(F.count(F.lit(1)).alias("n"))
        if targets is None:
            hist = materialize(hist, "radix-hist")
            targets = _targets(hist.groupBy("g").agg(F.sum("n").alias("n")), probs)
        targets = materialize(_follow(hist, targets), "radix-targets")
        done = upto
    return _bounds(targets, done, group)
