"""Continuous ingest: a stream of (tag, ts_ns, value) with per-tag state, appended to a table.

The state of a tag is the time and value hash of its last kept point: late points, points closer than the minimum
interval, and repeated values within the window are dropped as in batch. State is in RocksDB and survives restarts through
the checkpoint; batches are sorted by time per tag before they are judged.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from strandline.operators import ingest
from strandline.operators.ingest import keep_mask
from strandline.session import shared_dir, ship

# The process that sets up a stateful operator on the driver doesn't get the files shipped to executors.
for _module in (sys.modules[__name__], ingest):
    cloudpickle.register_pickle_by_value(_module)

_STATE = StructType([StructField("last_ts", LongType()), StructField("last_code", LongType())])


class KeptPoints(StatefulProcessor):
    """Late drop, minimum interval and value dedup against the last kept point of each tag.

    The points of a micro-batch come in order of time. A tag without points for ``ttl_s`` seconds is forgotten: its next point counts as its first.
    """

    def __init__(self, min_interval_ns: int, dedup_ns: int, ttl_s: int):
        self.rules, self.ttl_s = (min_interval_ns, dedup_ns), ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, self.ttl_s * 1000 if self.ttl_s else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [x for x in rows if len(x)]
        if not parts:
            return
        # one sort by time over the times alone; the values stay in the frames that they came in
        ts = np.concatenate([x.ts_ns.to_numpy(np.int64) for x in parts])
        code = np.concatenate([x.code.to_numpy(np.int64) for x in parts])
        order = np.argsort(ts, kind="stable")
        last = tuple(int(x) for x in self.last.get()) if self.last.exists() else None
        if last is not None:
            order = order[ts[order] >= last[0]]
        kept, last = keep_mask(ts[order], code[order], *self.rules, last)
        if last is not None:
            self.last.update(last)
        chosen = np.zeros(len(ts), dtype=bool)
        chosen[order[kept]] = True
        at = 0
        for x in parts:
            yield x.loc[chosen[at : at + len(x)], ["tag", "ts_ns", "value"]]
            at += len(x)

    def close(self) -> None:
        pass


def kept_stream(stream: DataFrame, min_interval_ns: int = 0, dedup_ns: int = 0, ttl_s: int = 0) -> DataFrame:
    """The points of a streaming (tag, ts_ns, value) that are kept. Rows with a null in any of the three are dropped. ``ttl_s``: seconds after
    which the state of a tag without new points is dropped (0: never); it must exceed the lateness and the window that the rules are to cover."""
    ship(stream.sparkSession)
    rows = stream.where("tag is not null and ts_ns is not null and value is not null")
    coded = rows.select("tag", F.col("ts_ns").cast("long").alias("ts_ns"), "value", F.xxhash64("value").alias("code"))
    kind = stream.schema["value"].dataType.simpleString()
    return coded.groupBy("tag").transformWithStateInPandas(
        KeptPoints(min_interval_ns, dedup_ns, ttl_s), f"tag string, ts_ns long, value {kind}", "Append", "ProcessingTime" if ttl_s else "None"
    )


def start_ingest(
    stream: DataFrame, database, table: str, name: str = "ingest", checkpoint: str | None = None, now_ns: int | None = None, available_now: bool = False, ttl_s: int = 0
) -> StreamingQuery:
    """Append a stream to a table; guards and quantisation per micro-batch, the kept-point rules in state.

    Each micro-batch is a batch of the table under the name of the query (as its checkpoint has it) and its number: one that is replayed takes the place of what it
    wrote before. Backpressure is the source's ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``. State that expires (``ttl_s``) keeps a query running, so that it
    can't go with ``available_now``.
    """
    if ttl_s and available_now:
        raise ValueError("a query whose state expires doesn't end by itself")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    c = database.config
    kept = kept_stream(stream, c.min_interval_ms * 1_000_000, c.dedup_ms * 1_000_000, ttl_s)
    where = checkpoint or f"{shared_dir(spark)}/stream-{name}"

    def store(batch: DataFrame, number: int) -> None:
        store_batch(database, table, batch, f"{query_id(spark, where)}-{number}", now_ns)

    writer = kept.writeStream.queryName(database.stream_name(name)).foreachBatch(store).outputMode("append").option("checkpointLocation", where)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def query_id(spark, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint over restarts."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def store_batch(database, table: str, batch: DataFrame, source: str, now_ns: int | None = None) -> None:
    """Write a micro-batch, whose points the kept-point rules have been applied to, once under its ``source``."""
    if not batch.isEmpty():
        whole = type(database)(batch.sparkSession, database.config)
        whole.append(table, batch, now_ns, strict=False, source=source)


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling windows per tag over event time with a watermark: count, average, minimum, maximum."""
    timed = stream.withColumn("ts", F.timestamp_micros(F.round((F.col("ts_ns") - F.pmod("ts_ns", F.lit(1000))) / 1000).cast("long")))
    return (
        timed.withWatermark("ts", late)
        .groupBy("tag", F.window("ts", width))
        .agg(F.count("value").alias("n"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
        .select("tag", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "avg", "min", "max")
    )
