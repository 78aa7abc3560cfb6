"""Ingest rules: guards, late-arrival drop, minimum-interval thinning, value deduplication, float quantisation, zero fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strandline.errors import EmptyValue, TimestampOutOfRange, TypeMismatch, UnsupportedFloat
from strandline.functions.quantize import quantize
from strandline.operators.downsample import pieces
from strandline.session import free_names

#: Arrival numbers per chunk of the running maximum.
ARRIVALS = 1_000_000


def guards(df: DataFrame, now_ns: int, ahead_ns: int = 0, value: str = "value", strict: bool = False, fits: Column | None = None) -> DataFrame:
    """Rows that may be stored: value not null, float neither NaN nor infinite, time at most ``ahead_ns`` after ``now_ns`` (0: any).

    ``strict`` raises for the first offending kind instead of dropping rows; that costs a pass over the input. Rows with null
    tag or time are dropped, or an EmptyValue in strict mode. ``fits`` is the value in its column's type: null for a value that can't be
    converted, which is a TypeMismatch in strict mode.
    """
    floating = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    finite = ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")) if floating else F.lit(True)
    present = F.col(value).isNotNull() & F.col("tag").isNotNull() & F.col("ts_ns").isNotNull()
    near = F.col("ts_ns") <= now_ns + ahead_ns if ahead_ns else F.lit(True)
    if strict:
        bad = df.agg(
            F.max((~present).cast("int")).alias("empty"), F.max((present & ~finite).cast("int")).alias("odd"), F.max((present & ~near).cast("int")).alias("far"),
            F.max((present & fits.isNull() if fits is not None else F.lit(False)).cast("int")).alias("other"),
        ).first()
        for flag, error in ((bad["empty"], EmptyValue), (bad["odd"], UnsupportedFloat), (bad["far"], TimestampOutOfRange), (bad["other"], TypeMismatch)):
            if flag:
                raise error(value)
    return df.where(present & finite & near)


def drop_late(df: DataFrame, arrival: str, chunk: int = ARRIVALS) -> DataFrame:
    """Rows that are not older than any kept row of their tag that arrived before; the first of a tag is always kept.

    The kept rows are those that reach the running maximum of time, which is built from chunks of the arrival number: each
    chunk's own running maximum, and the maximum of all chunks before it, so that one tag's rows spread over its chunks.
    """
    c, top, before_, high = free_names(df, "_c", "_top", "_before", "_high")
    rows = df.where("tag is not null and ts_ns is not null").withColumn(c, F.floor(F.col(arrival) / F.lit(chunk)))
    tops = rows.groupBy("tag", c).agg(F.max("ts_ns").alias(top))
    before = tops.select("tag", c, F.max(top).over(Window.partitionBy("tag").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)).alias(before_))
    own = Window.partitionBy("tag", c).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before, ["tag", c]).withColumn(high, F.greatest(F.max("ts_ns").over(own), F.col(before_)))
    return joined.where(F.col(high).isNull() | (F.col("ts_ns") >= F.col(high))).drop(c, before_, high)


def keep_mask(ts: np.ndarray, code: np.ndarray, min_interval: int, dedup: int, last: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int] | None]:
    """Which of one tag's points in order are kept, and the last kept (time, value code). State moves only with kept points."""
    kept = np.zeros(len(ts), dtype=bool)
    i, n = 0, len(ts)
    if last is None and n:
        kept[0], last, i = True, (int(ts[0]), int(code[0])), 1
    while i < n:
        t0, c0 = last
        i = max(i, int(np.searchsorted(ts, t0 + min_interval, side="left"))) if min_interval > 0 else i
        if dedup > 0:
            while i < n and ts[i] - t0 <= dedup and code[i] == c0:
                i += 1
        if i >= n:
            break
        if ts[i] < t0:
            i += 1
            continue
        kept[i], last = True, (int(ts[i]), int(code[i]))
        i += 1
    return kept, last


def _thin(min_interval: int, dedup: int, code: str, last_ts: str, last_code: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            ts, values = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("ts_ns", code))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for name, a, z in pieces(batch.column(names.index("tag"))):
                if name != tag:
                    tag, last = name, None
                    if last_ts in names:
                        at, what = (batch.column(names.index(c))[a].as_py() for c in (last_ts, last_code))
                        last = None if at is None else (at, what)
                keep[a:z], last = keep_mask(ts[a:z], values[a:z], min_interval, dedup, last)
            yield batch.filter(pa.array(keep)).select([c for c in names if c not in (code, last_ts, last_code)])

    return run


def thin(df: DataFrame, min_interval_ns: int = 0, dedup_ns: int = 0, value: str = "value", order: str | None = None, last: DataFrame | None = None) -> DataFrame:
    """Minimum-interval thinning and value deduplication against the last *kept* point of the tag.

    In order of time (ties: ``order``): the first point is kept; one closer than the interval (<) to the last kept is dropped;
    one within the window (<=) whose value equals the last kept value is dropped. Each tag is one sorted stream
    with two numbers of state; nothing is gathered. Values are compared by a 64-bit hash. Null tags and times are left out.
    ``last`` (tag, ts_ns, ``value``) has the points that were kept before, one per tag: the first point of such a tag is judged against it.
    """
    names = free_names(df, "_v", "_last_ts", "_last_v")
    rows = df.where("tag is not null and ts_ns is not null").withColumn(names[0], F.xxhash64(value))
    if last is not None:
        known = last.select("tag", F.col("ts_ns").alias(names[1]), F.xxhash64(value).alias(names[2]))
        rows = rows.join(known, "tag", "left")
    streams = rows.repartition("tag").sortWithinPartitions("tag", "ts_ns", *([order] if order else []))
    return streams.select(*df.columns, *(names if last is not None else names[:1])).mapInArrow(_thin(min_interval_ns, dedup_ns, *names), df.schema)


def reorder(df: DataFrame, *order: str) -> DataFrame:
    """Partitions by tag, each sorted by (tag, time, ``order``): the layout that range reads and folds want."""
    return df.repartition("tag").sortWithinPartitions("tag", "ts_ns", *order)


def quantized(df: DataFrame, precision: int, value: str = "value") -> DataFrame:
    return df.withColumn(value, quantize(F.col(value), precision))


def zero_of(kind: T.DataType) -> Column:
    """What a missing member reads as: the zero of its type."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StructType):
        return F.struct(*[zero_of(f.dataType).alias(f.name) for f in kind])
    return F.lit(0).cast(kind)


def zero_fill(df: DataFrame, column: str = "value") -> DataFrame:
    """Missing members of a struct column as typed zeros; a null struct becomes one of zeros."""

    def fill(at: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[fill(at[f.name], f.dataType).alias(f.name) for f in kind])
        return F.coalesce(at, zero_of(kind))

    return df.withColumn(column, fill(F.col(column), df.schema[column].dataType))


#: What the kinds of an adaptive value are called.
_KINDS = {
    "BIGINT": "int", "INT": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "float",
    "STRING": "string", "BOOLEAN": "bool", "OBJECT": "map", "ARRAY": "list",
}


_TAKES = (("float", "int"), ("float", "bool"))


def accepts(stored: str, incoming: str) -> bool:
    """Whether a column of one type takes values of another: the same type, and ints and bools into floats."""
    return stored == incoming or (stored, incoming) in _TAKES


def type_changes(df: DataFrame, value: str = "value", order: str = "seq") -> DataFrame:
    """(path, kinds) of each member of an adaptive column whose type changes to one that the type it had first doesn't take.

    Members are those of the top level; a value that is no map has the path ''. ``kinds`` are the types in order of appearance. A map
    takes maps only. Nulls have no type.
    """
    named = lambda k: F.coalesce(*[F.when(k.startswith(x), n) for x, n in _KINDS.items()])
    whole = df.select(F.lit("").alias("path"), named(F.schema_of_variant(value)).alias("kind"), F.col(order).alias("o"))
    maps = df.where(F.schema_of_variant(value).startswith("OBJECT"))
    members = maps.select(F.explode(F.from_json(F.to_json(value), "map<string,variant>")).alias("path", "x"), F.col(order).alias("o"))
    every = whole.unionByName(members.select("path", named(F.schema_of_variant("x")).alias("kind"), "o")).where("kind is not null")
    firsts = every.groupBy("path", "kind").agg(F.min("o").alias("o"))  # at most as many rows a path as there are kinds
    kinds = firsts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("o", "kind"))).kind.alias("kinds"))
    first = F.col("kinds")[0]
    taken = lambda k: (k == first) | F.struct(first, k).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in _TAKES])
    return kinds.where(F.exists("kinds", lambda k: ~taken(k)))


def evolve(df: DataFrame, value: str, stored: str) -> tuple[DataFrame, DataFrame]:
    """(rows cast to the stored type, rows that don't fit). A conversion that fails puts the row into quarantine."""
    to = {"int": "bigint", "float": "double", "string": "string", "bool": "boolean"}[stored]
    cast = F.col(value).try_cast(to)
    fits = cast.isNotNull() | F.col(value).isNull()
    return df.where(fits).withColumn(value, cast), df.where(~fits)
