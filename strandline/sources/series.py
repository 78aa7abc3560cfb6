"""Any DataFrame as series: (tag, ts_ns, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unix_ns(ts: Column) -> Column:
    """Unix ns of a timestamp (with or without zone; UTC session)."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def as_series(df: DataFrame, tag: Column | str, ts_ns: Column | str, value: Column | str, *keep: Column | str) -> DataFrame:
    """``tag`` as string, ``ts_ns`` as long, ``value``, and further columns to keep."""
    to = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(to(tag).cast("string").alias("tag"), to(ts_ns).cast("long").alias("ts_ns"), to(value).alias("value"), *keep)
