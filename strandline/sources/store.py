"""The database: tables of tagged series as Parquet, written and read through DataFrames.

A table is a folder of batches, each partitioned by UTC day, its files sorted by (tag, ts_ns), so that a range of one tag reads the
row groups that hold it. A batch is there for readers once it is written whole. Each batch has a number, allotted in order of arrival and taken by creating a file of that name, which only one can do. A
batch that is written again (a replayed micro-batch) has its old number and takes the place of what it wrote before. Beside the data there is a table of each tag's
newest point, up to some batch; whoever needs it adds the batches since then, reading no others. Compaction writes a new version of
the folder, which the list of tables then names. Compression, buffers, log replay and block indexes are Parquet's and Spark's business.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strandline.catalog import BOOL, DEFAULT_TABLE, FLOAT, INT, JSON, STRING, STRUCTURE, UNKNOWN, Catalog, ColumnAttribute, TableInfo
from strandline.errors import DatabaseClosed, InvalidPredicate, LateRecord, NoDataForTag, TableNotFound, TagNotFound, TypeMismatch
from strandline.functions.predicates import build
from strandline.functions.quantize import quantize
from strandline.operators import ingest, reads
from strandline.operators.downsample import HOUR_NS, downsample, downsample_adaptive, downsample_first
from strandline.session import ship, shuffle_width

CODECS = ("zstd", "lz4", "snappy", "gzip", "none")
DAY_NS = 86_400_000_000_000


@dataclass
class Config:
    """What can be set of a database; times in the unit of their name, 0 switches a rule off.

    ``sweep_s``: seconds between the sweeps that writing does where ``expiration_min`` is set. ``refuse_type_changes``: a member of an adaptive
    table that changes its type within the rows written is an error instead of being stored as it is. ``cluster``: the rows of a batch are brought
    together by day, tag and time before they are written; without, each task writes its own rows sorted, which shuffles nothing and suits input in order of time. ``compact`` clusters in any case.
    """

    path: str
    compression: str = "zstd"
    max_ahead_s: int = 0
    expiration_min: int = 0
    dedup_ms: int = 0
    min_interval_ms: int = 0
    sweep_s: int = 60
    refuse_type_changes: bool = False
    cluster: bool = True


#: The codes of aggregations; any other one averages.
AGGREGATIONS = {1: "min", 2: "max", "min": "min", "max": "max"}


def dispatch(series: DataFrame, tag: str, start: int, end: int, budget: int, mode: str | int, predicate=None, order: str | None = None, newest: DataFrame | None = None) -> DataFrame:
    """Raw rows for a span of at most an hour, whatever budget and mode; a longer span is downsampled.

    ``mode`` is ``min``, ``max`` or their codes; anything else averages. ``newest`` (tag, until) has the tag's newest time, if it is known already."""
    if end - start <= HOUR_NS:
        return reads.range_scan(series, start, end, tag, predicate).orderBy("ts_ns", *([order] if order else []))
    one = series.where(F.col("tag") == tag)
    kind = series.schema["value"].dataType
    where = None if predicate is None else build(predicate, "value", kind)
    mode = AGGREGATIONS.get(mode, "avg")
    if isinstance(kind, T.NumericType):
        return downsample(one, budget, mode, start, end, where, order, newest)
    if isinstance(kind, T.VariantType):
        return downsample_adaptive(one, budget, mode, start, end, where, order, newest)
    return downsample_first(one, budget, order, start, end, where, newest)


class Database:
    """Open tables under ``config.path``; what is there already is found again."""

    def __init__(self, spark: SparkSession, config: Config | str):
        self.spark = spark
        self.config = Config(config) if isinstance(config, str) else config
        ship(spark)
        self.catalog = Catalog(spark, self.config.path)
        self.open = True
        self._swept: dict[str, int] = {}

    # --- tables

    def create_table(self, name: str, column: ColumnAttribute | None = None) -> TableInfo:
        return self.catalog.create(TableInfo(name or DEFAULT_TABLE, column or ColumnAttribute()))

    def tables(self) -> list[str]:
        return sorted(self.catalog.tables)

    def close(self) -> None:
        """Stop this database's streams; nothing can be read or written through it any more."""
        for q in self.spark.streams.active:
            if (q.name or "").startswith(self.stream_name("")):
                q.stop()
        self.open = False

    def stream_name(self, name: str) -> str:
        return f"strandline-{self.config.path}-{name}"

    def _info(self, table: str) -> TableInfo:
        if not self.open:
            raise DatabaseClosed(self.config.path)
        self.catalog.load()
        return self.catalog.get(table)

    def _schema(self, info: TableInfo) -> T.StructType:
        long = T.LongType()
        return T.StructType([T.StructField("tag", T.StringType()), T.StructField("ts_ns", long), T.StructField("value", info.column.spark_type()), *(T.StructField(c, long) for c in ("arrived", "seq", "day", "batch"))])

    def series(self, table: str = "") -> DataFrame:
        """(tag, ts_ns, value, arrived, seq, day, batch) of the whole table; a table without data has no rows. Rows arrived in the
        order of (arrived, seq): the number of the batch they were written in, and their place in it."""
        return self._series(self._info(table))

    def _series(self, info: TableInfo, after: int = 0, upto: int | None = None) -> DataFrame:
        """Rows of the batches that are written whole, or of those with numbers above ``after`` up to ``upto``."""
        folder = f"{self.catalog.folder(info.name)}/data"
        fs, p = self._path(f"{folder}/batch=*/_SUCCESS")
        numbers = [int(x.getPath().getParent().getName().split("=")[1]) for x in fs.globStatus(p) or []]
        paths = [f"{folder}/batch={n}" for n in sorted(numbers) if n > after and (upto is None or n <= upto)]
        if not paths:
            return self.spark.createDataFrame([], self._schema(info))
        df = self.spark.read.schema(self._schema(info)).option("basePath", folder).parquet(*paths)
        return df if info.swept_day is None else df.where(F.col("day") >= info.swept_day)

    # --- files

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def _last_batch(self, info: TableInfo) -> int:
        return max([int(x) for x in self._names(f"{self.catalog.folder(info.name)}/batches") if x.isdigit()], default=0)

    def _next_batch(self, info: TableInfo, source: str | None) -> int:
        """Number of a new batch; that of the batch that the same ``source`` wrote before, if there is one."""
        folder = self.catalog.folder(info.name)
        named = f"{folder}/batches/source-{source}"
        if source is not None:
            before = [x for x in self._names(named)]
            if before:
                return int(before[0])
        n = self._last_batch(info)
        while True:
            n += 1
            fs, p = self._path(f"{folder}/batches/{n}")
            if fs.createNewFile(p):
                break
        if source is not None:
            fs, p = self._path(f"{named}/{n}")
            fs.createNewFile(p)
        return n

    def newest(self, table: str) -> DataFrame:
        """(tag, ts_ns, arrived, seq, value): each tag's newest point ever written, retention or not; of equal times the last to arrive."""
        return self._newest(self._info(table))

    def _newest(self, info: TableInfo, before: int | None = None) -> DataFrame:
        folder = f"{self.catalog.folder(info.name)}/newest"
        last = self._last_batch(info) if before is None else before - 1
        whole = [int(x) for x in self._names(folder) if x.isdigit() and int(x) <= last and self._exists(f"{folder}/{x}/_SUCCESS")]
        have = max(whole, default=0)
        fields = [f for f in self._schema(info) if f.name not in ("day", "batch")]
        schema = T.StructType([fields[i] for i in (0, 1, 3, 4, 2)])
        old = self.spark.read.schema(schema).parquet(f"{folder}/{have}") if have else None
        if have == last:
            return old if have else self.spark.createDataFrame([], schema)
        since = self._series(info, have, last).select(schema.names)
        both = since if old is None else old.unionByName(since)
        own = f"{folder}/new-{uuid.uuid4().hex}"
        reads.latest(both, "arrived", "seq").write.parquet(own)
        fs, p = self._path(own)
        if self._exists(f"{folder}/{last}") or not fs.rename(p, self._path(f"{folder}/{last}")[1]):
            self._delete(own)  # somebody else has written the same
        for x in whole[:-1]:  # the one before stays for those who are reading it
            self._delete(f"{folder}/{x}")
        return self.spark.read.schema(schema).parquet(f"{folder}/{last}")

    # --- writing

    def _now(self, now_ns: int | None) -> int:
        return time.time_ns() if now_ns is None else now_ns

    def write(self, table: str, tag: str, ts_ns: int, value: Any, now_ns: int | None = None) -> bool:
        """One point; False if a rule skips it. A stored point that is newer makes it late, which is an error. Prefer ``write_batch``."""
        info = self._for_writing(table)
        last = self._newest(info).where(F.col("tag") == tag).select("ts_ns").first()
        if last is not None and ts_ns < last[0]:
            raise LateRecord(f"{tag}: {ts_ns} is before {last[0]}")
        return self.write_batch(table, [(tag, ts_ns, value)], now_ns) == 1

    def _for_writing(self, table: str) -> TableInfo:
        name = table or DEFAULT_TABLE
        if self.open and name == DEFAULT_TABLE and name not in self.catalog.tables:
            self.catalog.load()
            if name not in self.catalog.tables:
                self.create_table(name)
        return self._info(name)

    def _points(self, info: TableInfo, points: Iterable[tuple[str, int, Any]]) -> DataFrame:
        rows = list(points)
        kind = info.column.spark_type()
        if isinstance(kind, T.VariantType):
            texts = [(t, ts, None if v is None else json.dumps(v)) for t, ts, v in rows]
            return self.spark.createDataFrame(texts, "tag string, ts_ns long, value string").withColumn("value", F.parse_json("value"))
        if info.column.type == FLOAT:
            rows = [(t, ts, None if v is None else float(v)) for t, ts, v in rows]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField("tag", T.StringType()), T.StructField("ts_ns", T.LongType()), T.StructField("value", kind)]))

    def prepare(self, table: str, df: DataFrame, now_ns: int | None = None, strict: bool = True, judged: bool = False) -> DataFrame:
        """The rows of ``df`` (tag, ts_ns, value) that are to be stored: guarded, cast, quantised, thinned, with their place (``seq``) and day.

        Rows older than their tag's newest stored point are late and left out; thinning starts from that point. Within ``df`` none is
        late, since it is sorted by time; of equal times the first to arrive comes first. ``judged``: both was done already.
        """
        info = self._for_writing(table)
        c = self.config
        kind, have = info.column.spark_type(), df.schema["value"].dataType
        rows = df.select("tag", "ts_ns", "value", F.monotonically_increasing_id().alias("seq"))
        cast = None
        if have != kind and not isinstance(kind, (T.VariantType, T.StructType)):
            cast = F.col("value").try_cast(kind)
        rows = ingest.guards(rows, self._now(now_ns), c.max_ahead_s * 1_000_000_000, strict=strict, fits=cast)
        if cast is not None:
            rows = rows.withColumn("value", cast).where("value is not null")
        elif isinstance(kind, T.VariantType) and not isinstance(have, T.VariantType):
            rows = rows.withColumn("value", F.to_variant_object("value") if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) else F.col("value").cast("variant"))
        elif isinstance(kind, T.StructType):
            rows = rows.withColumn("value", _shape(F.col("value"), have, kind))
        if isinstance(kind, T.VariantType) and c.refuse_type_changes and (changed := ingest.type_changes(rows).first()):
            raise TypeMismatch(f"{info.name}: {changed['path'] or 'value'} is {changed['kinds']}")
        rows = rows.withColumn("value", _quantised(F.col("value"), info.column))
        if not judged:
            known = self._newest(info) if self._last_batch(info) else None
            if c.dedup_ms or c.min_interval_ms:
                hashed = lambda x: x.withColumn("_h", F.xxhash64(F.to_json("value") if isinstance(kind, T.VariantType) else F.col("value")))
                rows = ingest.thin(hashed(rows), c.min_interval_ms * 1_000_000, c.dedup_ms * 1_000_000, "_h", "seq", None if known is None else hashed(known)).drop("_h")
            elif known is not None:
                newest = known.select("tag", F.col("ts_ns").alias("_newest"))
                rows = rows.join(newest, "tag", "left").where("_newest is null or ts_ns >= _newest").drop("_newest")
        return rows.withColumn("day", reads.day_of(F.col("ts_ns")))

    def append(self, table: str, df: DataFrame, now_ns: int | None = None, strict: bool = True, source: str | None = None, judged: bool = False) -> int:
        """Write a DataFrame of any size as one batch; gives the batch's number. Rows are spread by ranges of (day, tag, time) of equal size, so a tag
        with most of the rows is spread too. What the same ``source`` wrote before is replaced, so that a replay counts once."""
        info = self._for_writing(table)
        ready = self.prepare(table, df, now_ns, strict, judged or source is not None)
        batch = self._next_batch(info, source)
        self._write(ready.select("tag", "ts_ns", "value", F.lit(batch).cast("long").alias("arrived"), "seq", "day"), f"{self.catalog.folder(info.name)}/data/batch={batch}", self.config.cluster)
        self._sweep_in_turn(info.name, now_ns)
        return batch

    def _write(self, rows: DataFrame, folder: str, cluster: bool = True) -> None:
        codec = self.config.compression if self.config.compression in CODECS else "none"
        laid = rows.repartitionByRange(shuffle_width(self.spark), "day", "tag", "ts_ns") if cluster else rows
        out = laid.sortWithinPartitions("day", "tag", "ts_ns", "arrived", "seq")
        out.write.partitionBy("day").option("compression", codec).mode("overwrite").parquet(folder)

    def write_batch(self, table: str, points: Iterable[tuple[str, int, Any]], now_ns: int | None = None) -> int:
        """Points as (tag, ts_ns, value): all are checked before any is written. Gives the number written; nothing for no points."""
        info = self._for_writing(table)
        rows = list(points)
        if not rows:
            return 0
        batch = self.append(info.name, self._points(info, rows), now_ns)
        return self._series(info, batch - 1, batch).count()

    # --- reading

    def _ranged(self, table: str, tag: str, start: int, end: int, now_ns: int | None, missing_ok: bool) -> tuple[DataFrame, DataFrame, int, int] | None:
        """(rows of the days in question, the tag's newest point, start, end)."""
        try:
            info = self._info(table)
        except TableNotFound:
            if missing_ok:
                return None
            raise
        newest = self._newest(info).where(F.col("tag") == tag)
        if not newest.limit(1).count():
            raise TagNotFound(tag)
        start, end = reads.clamp(start, end, self._now(now_ns), self.config.expiration_min * 60 * 1_000_000_000)
        return _days(self._series(info), start, end), newest, start, end

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "tag string, ts_ns long, value double")

    def query_all(self, table: str, tag: str, start: int, end: int, predicate=None, strict: bool = False, zero_fill: bool = False, now_ns: int | None = None, missing_ok: bool = False) -> DataFrame:
        """(tag, ts_ns, value) in order of time, start and end included."""
        got = self._ranged(table, tag, start, end, now_ns, missing_ok)
        if got is None:
            return self._empty()
        df, _, start, end = got
        out = reads.range_scan(df, start, end, tag, predicate, strict)
        if zero_fill and isinstance(df.schema["value"].dataType, T.StructType):
            out = ingest.zero_fill(out)
        return out.orderBy("ts_ns", "arrived", "seq").select("tag", "ts_ns", "value")

    def query(self, table: str, tag: str, start: int, end: int, budget: int = 0, mode: str | int = "avg", predicate=None, now_ns: int | None = None, missing_ok: bool = False) -> DataFrame:
        """As ``query_all`` for spans of up to an hour; longer ones are downsampled to ``budget`` rows (0: 10,000)."""
        got = self._ranged(table, tag, start, end, now_ns, missing_ok)
        if got is None:
            return self._empty()
        df, newest, start, end = got
        # the newest point of the tag counts although it may be outside of the range
        ordered = df.withColumn("_order", F.struct("arrived", "seq"))
        out = dispatch(ordered, tag, start, end, budget, mode, predicate, "_order", newest.select("tag", F.col("ts_ns").alias("until")))
        return out.select("tag", "ts_ns", "value").orderBy("ts_ns")

    def query_latest(self, table: str, tag: str):
        """(ts_ns, value) of the tag's newest point; an unknown tag and one without data left are errors."""
        info = self._info(table)
        row = self._newest(info).where(F.col("tag") == tag).first()
        if row is None:
            raise TagNotFound(tag)
        if info.swept_day is not None and row["ts_ns"] // DAY_NS < info.swept_day:
            raise NoDataForTag(tag)
        return row["ts_ns"], row["value"]

    def query_latest_all(self, table: str) -> DataFrame:
        """(tag, ts_ns, value) of every tag that has data."""
        info = self._info(table)
        rows = self._newest(info)
        return (rows if info.swept_day is None else rows.where(F.col("ts_ns") >= info.swept_day * DAY_NS)).select("tag", "ts_ns", "value")

    def tags(self, table: str) -> DataFrame:
        return self.newest(table).select("tag")

    # --- upkeep

    def sweep(self, table: str, now_ns: int | None = None) -> int:
        """Drop the days that ended before the expiration; the newest day stays. Gives the number of days dropped.

        The list of tables is changed first: from then on no reader sees the days, whether their files are gone yet or not."""
        keep = self.config.expiration_min * 60 * 1_000_000_000
        if not keep:
            return 0
        info = self._info(table)
        folder = f"{self.catalog.folder(info.name)}/data"
        batches = {x: [int(d.split("=")[1]) for d in self._names(f"{folder}/{x}") if d.startswith("day=")] for x in self._names(folder)}
        days = sorted({d for x in batches.values() for d in x})
        old = [d for d in days[:-1] if (d + 1) * DAY_NS <= self._now(now_ns) - keep]
        if old:
            self._newest(info)  # of all tags, as long as their data are there
            info.swept_day = max(old[-1] + 1, info.swept_day or 0)
            self.catalog.store()
        for x, own in batches.items():
            for d in set(own) & set(old):
                self._delete(f"{folder}/{x}/day={d}")
        return len(old)

    def _sweep_in_turn(self, name: str, now_ns: int | None) -> None:
        now = self._now(now_ns)
        if self.config.expiration_min and now - self._swept.get(name, 0) >= self.config.sweep_s * 1_000_000_000:
            self._swept[name] = now
            self.sweep(name, now)

    def compact(self, table: str) -> None:
        """Rewrite a table as one batch with few sorted files per day, in a new version of its folder. The version before stays until the next
        time, for those who are reading it. Nobody may write meanwhile."""
        info = self._info(table)
        last = self._last_batch(info)
        if not last:
            return
        whole, newest = self._series(info), self._newest(info)
        new = f"{self.config.path}/{info.name}/v{info.version + 1}"
        self._delete(new)  # left by a compaction that was broken off
        self._write(whole.drop("batch"), f"{new}/data/batch={last}")
        newest.write.parquet(f"{new}/newest/{last}")
        fs, p = self._path(f"{new}/batches/{last}")
        fs.createNewFile(p)
        fs, old = self._path(f"{self.catalog.folder(info.name)}/batches")
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        for name in self._names(old.toString()):
            if name.startswith("source-"):  # a replay may still come
                util.copy(fs, self._path(f"{old.toString()}/{name}")[1], fs, self._path(f"{new}/batches/{name}")[1], False, self.spark._jsc.hadoopConfiguration())
        info.version += 1
        self.catalog.store()
        self._delete(f"{self.config.path}/{info.name}/v{info.version - 2}")


def _days(df: DataFrame, start: int, end: int) -> DataFrame:
    """Partition pruning by the days of the range."""
    return df.where(F.col("day").between(start // DAY_NS, end // DAY_NS))


@F.pandas_udf(T.StringType())
def _quantised_json(texts: pd.Series, precision: pd.Series) -> pd.Series:
    def walk(v, scale):
        if isinstance(v, float) and math.isfinite(v * scale):
            return math.ceil(v * scale - 1e-9) / scale
        if isinstance(v, dict):
            return {k: walk(x, scale) for k, x in v.items()}
        return [walk(x, scale) for x in v] if isinstance(v, list) else v

    return pd.Series([None if t is None else json.dumps(walk(json.loads(t), float(10**p))) for t, p in zip(texts, precision)])


def _quantised(value: Column, column: ColumnAttribute) -> Column:
    """Floats rounded up to the decimals of their column; members of a structure to their own (0: as they are), those of an adaptive
    value, and of lists and maps in it, to the table's."""
    if column.type == FLOAT:
        return quantize(value, column.float_precision) if column.float_precision else value
    if column.type == STRUCTURE:
        return F.when(value.isNotNull(), F.struct(*[_quantised(value[c.name], c).alias(c.name) for c in column.structure]))
    if column.type != UNKNOWN or not column.float_precision:
        return value
    kind = F.schema_of_variant(value)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    text = _quantised_json(F.when(nested, F.to_json(value)), F.lit(column.float_precision))
    number = quantize(F.try_variant_get(value, "$", "double"), column.float_precision).cast("variant")
    return F.when(nested, F.parse_json(text)).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number).otherwise(value)


def _shape(value, have: T.DataType, want: T.DataType):
    """A struct brought to the declared members: missing ones are null, others are left out."""
    if isinstance(want, T.StructType):
        names = have.names if isinstance(have, T.StructType) else []
        return F.struct(*[(_shape(value[f.name], have[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
    return value.try_cast(want) if have != want else value


__all__ = ["BOOL", "FLOAT", "INT", "JSON", "STRING", "STRUCTURE", "UNKNOWN", "ColumnAttribute", "Config", "Database", "InvalidPredicate", "dispatch", "quantize"]
