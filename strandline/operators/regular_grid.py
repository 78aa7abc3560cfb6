"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_NS = 86_400_000_000_000


def instant_ns(tms: Column) -> Column:
    """Unix ns of a time stored in s, ms, us or ns; the magnitude tells which (years 1973 to 5138 are unambiguous)."""
    size = F.abs(tms)
    return (
        F.when(size < 100_000_000_000, tms * 1_000_000_000)
        .when(size < 100_000_000_000_000, tms * 1_000_000)
        .when(size < 100_000_000_000_000_000, tms * 1_000)
        .otherwise(tms)
    )


def readings(points: DataFrame, headers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tag_key, at_ns, v, point_id, period_ns): the finite, non-null points of blocks whose ``attr_code`` is a tag.

    Points with null time or value, of unknown blocks, or of tags without a positive period are left out.
    Repeated points and blocks stay: they fall into the same slot. Negative zero reads as zero.
    """
    p = points.select("point_id", "block_id", instant_ns(F.col("tms")).alias("at_ns"), (F.col("v") + F.lit(0.0)).alias("v")).where(
        "v is not null and not isnan(v) and abs(v) != double('infinity') and at_ns is not null"
    )
    h = headers.where("attr_code is not null and attr_code != 0").select("block_id", F.col("attr_code").alias("tag_key"))
    d = dictionary.where("period_s > 0").select("tag_key", (F.col("period_s") * 1_000_000_000).alias("period_ns"))
    return p.join(h.join(d, "tag_key"), "block_id").select("tag_key", "at_ns", "v", "point_id", "period_ns")


def _floor(value: Column, step: Column) -> Column:
    return value - F.pmod(value, step)


def regular_series(rows: DataFrame, max_gap: int = 3, within_day: bool = False) -> DataFrame:
    """Per source, every slot from its first to its last slot that has a reading; ``within_day``: per source and UTC day
    with readings, from the first to the last slot of that day.

    Columns: ``tag_key``, ``slot_ns`` (a multiple of the period), ``n`` readings in it, ``value``: the slot's last
    reading by time, then ``point_id``; in a slot without reading the last observation before, if it is at most
    ``max_gap`` slots back, else null; ``state``: ``observed``, ``filled`` or ``missing``. A day belongs to its slots'
    starts. Readings are aggregated to slots before anything else moves; the sequence, the join and the carry
    forward run per (source, day), so a source with most of the readings is spread over its days. What a day takes over
    from the days before is carried over one row per (source, day). Empty input gives no rows.
    """
    slots = (
        rows.withColumn("slot_ns", _floor(F.col("at_ns"), F.col("period_ns")))
        .groupBy("tag_key", "period_ns", "slot_ns")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at_ns", "point_id", "v")).alias("tip"))
        .select("tag_key", "period_ns", "slot_ns", "n", F.col("tip.v").alias("v"), _floor(F.col("slot_ns"), F.lit(DAY_NS)).alias("day_ns"))
    )
    # At most one row per slot is left here, so a (source, day) has no more than a day's slots.
    days = slots.groupBy("tag_key", "day_ns", "period_ns").agg(
        F.min("slot_ns").alias("a"), F.max("slot_ns").alias("z"), F.max(F.struct(F.col("slot_ns").alias("at"), "v")).alias("end")
    )
    span = days if within_day else _whole_span(days)
    grid = span.select("tag_key", "day_ns", "period_ns", "end", F.explode(F.sequence("a", "z", "period_ns")).alias("slot_ns"))
    seen = slots.select("tag_key", "day_ns", "slot_ns", "n", "v")
    day = Window.partitionBy("tag_key", "day_ns").orderBy("slot_ns").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("n").isNotNull(), F.struct(F.col("slot_ns").alias("at"), "v")), ignorenulls=True).over(day)
    back = (F.col("slot_ns") - F.col("seen.at")) / F.col("period_ns")
    return (
        grid.join(seen, ["tag_key", "day_ns", "slot_ns"], "left")
        .withColumn("seen", F.coalesce(own, "end"))
        .select(
            "tag_key",
            "slot_ns",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.when(back <= max_gap, F.col("seen.v")).alias("value"),
            F.when(F.col("n").isNotNull(), "observed").when(back <= max_gap, "filled").otherwise("missing").alias("state"),
        )
    )


def _whole_span(days: DataFrame) -> DataFrame:
    """``days`` with the slots up to the next day with readings: the rest of the day, and a row for each day between that has a slot.

    A day with readings begins with one, so only the days added take over ``end``, the last observation before them.
    """
    order = Window.partitionBy("tag_key").orderBy("day_ns")
    step, from_, to = F.col("period_ns"), F.col("first_ns"), F.col("last_ns")
    # each row stands for the slots from its own first up to the next row's first, cut at midnight
    runs = days.select(
        "tag_key", "period_ns", "end", F.col("day_ns").alias("own_ns"),
        F.col("a").alias("first_ns"), F.coalesce(F.lead("a").over(order) - step, "z").alias("last_ns"),
    )
    cut = runs.withColumn("day_ns", F.explode(F.sequence("own_ns", _floor(to, F.lit(DAY_NS)), F.lit(DAY_NS))))
    start = _floor(F.col("day_ns") + step - 1, step)  # first slot at or after midnight
    stop = _floor(F.col("day_ns") + F.lit(DAY_NS - 1), step)
    return (
        cut.withColumn("a", F.greatest(start, from_))
        .withColumn("z", F.least(stop, to))
        .where("a <= z")  # a period longer than a day leaves days without a slot
        .select("tag_key", "day_ns", "period_ns", "a", "z", "end")
    )
