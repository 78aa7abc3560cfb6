"""Reads of series: raw ranges, latest values, the tag dictionary, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.predicates import build
from strandline.session import materialize, shuffle_width


DAY_NS = 86_400_000_000_000


def day_of(ts_ns: Column) -> Column:
    """UTC day of a time in ns, in whole numbers: doubles can't tell the last ns of a day from the next day."""
    return F.round((ts_ns - F.pmod(ts_ns, F.lit(DAY_NS))) / F.lit(DAY_NS)).cast("long")


def clamp(start: int, end: int, now_ns: int, expiration_ns: int) -> tuple[int, int]:
    """The range within the time that is kept; no expiration leaves it as it is."""
    if expiration_ns <= 0:
        return start, end
    return max(start, now_ns - expiration_ns), min(end, now_ns + expiration_ns)


def range_scan(series: DataFrame, start: int | None = None, end: int | None = None, tag: str | None = None, predicate=None, strict: bool = False) -> DataFrame:
    """Rows of a tag (or all) with start <= ts_ns <= end that match the predicate tree. Plain comparisons, so they reach the Parquet
    scan; rows with null time match no range."""
    out = series
    if tag is not None:
        out = out.where(F.col("tag") == tag)
    if start is not None:
        out = out.where(F.col("ts_ns") >= start)
    if end is not None:
        out = out.where(F.col("ts_ns") <= end)
    if predicate is not None:
        out = out.where(build(predicate, "value", series.schema["value"].dataType, strict))
    return out


def latest(series: DataFrame, *arrival: str) -> DataFrame:
    """(tag, ts_ns, value, and ``arrival``) of each tag's newest row; of equal times the last to arrive, by the columns ``arrival``.
    One map-side combined aggregate, for values of any type; null tags and times are left out."""
    order = F.struct("ts_ns", *arrival) if arrival else F.col("ts_ns")
    return (
        series.where("tag is not null and ts_ns is not null")
        .groupBy("tag")
        .agg(F.max(order).alias("_at"), F.max_by("value", order).alias("value"))
        .select("tag", *([f"_at.{c}" for c in ("ts_ns", *arrival)] if arrival else [F.col("_at").alias("ts_ns")]), "value")
    )


def tag_dictionary(series: DataFrame, arrival: str) -> DataFrame:
    """(tag, code): codes from 1 by first appearance (ties by name).

    Distinct tags are range-sorted, counted per range, and numbered within their range from the count of those before, so
    that any number of tags is numbered without gathering them.
    """
    first = series.where("tag is not null").groupBy("tag").agg(F.min(arrival).alias("f"))
    ranged = materialize(first.repartitionByRange(shuffle_width(series.sparkSession), "f", "tag").withColumn("part", F.spark_partition_id()), "tags")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # one row per range
    before = parts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("f", "tag"))
    return ranged.withColumn("own", own).join(F.broadcast(before), "part").select("tag", (F.col("before") + F.col("own")).cast("long").alias("code"))


def retained(series: DataFrame, now_ns: int, expiration_ns: int) -> DataFrame:
    """Rows not older than the expiration, by the time of the data. 0 keeps all."""
    return series.where(F.col("ts_ns") >= now_ns - expiration_ns) if expiration_ns > 0 else series
