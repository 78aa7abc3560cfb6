"""Queries that go through the database and through Structured Streaming, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.catalog import FLOAT, STRING, STRUCTURE, UNKNOWN, ColumnAttribute
from strandline.functions.predicates import Condition, all_of
from strandline.plans.series_queries import _S_EVENTS, _THIN, HOUR_NS, MINUTE, NOW, T0, T1, chain_sql, events
from strandline.session import load, shared_dir
from strandline.sources.series import as_series, unix_ns
from strandline.sources.store import CODECS, Config, Database
from strandline.streaming.ingest_stream import kept_stream, store_batch, windowed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _database(spark: SparkSession, **kw) -> Database:
    return Database(spark, Config(f"{shared_dir(spark)}/db-{uuid.uuid4().hex}", **kw))


def _floats(spark: SparkSession, d: str, **kw) -> Database:
    db = _database(spark, **kw)
    db.create_table("events", ColumnAttribute("value", FLOAT, float_precision=1))
    db.append("events", events(spark, d), NOW)
    return db


_UP = "ceil(value * 10.0::DOUBLE - 1e-9::DOUBLE) / 10.0::DOUBLE"
for _codec in CODECS:
    _add(
        f"store_roundtrip_{_codec}",
        lambda spark, d, codec=_codec: _floats(spark, d, compression=codec).series("events").select("tag", "ts_ns", "value"),
        f"SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, {_UP} AS value FROM events",
    )
_add(
    "store_query_all",
    lambda spark, d: _floats(spark, d).query_all("events", "click", T0, T1, all_of(Condition("", ">", 20), Condition("", "<", 80)), now_ns=NOW),
    f"SELECT * FROM (SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, {_UP} AS value FROM events) WHERE tag = 'click' AND ts_ns BETWEEN {T0} AND {T1} AND value > 20 AND value < 80",
)
_add(
    "store_query_downsampled",
    lambda spark, d: _floats(spark, d).query("events", "view", T0, T1, 60, "max", now_ns=NOW),
    chain_sql(_S_EVENTS.replace(" value,", f" {_UP} AS value,") + " WHERE event_type = 'view'", 60, "max", f"s.ts_ns BETWEEN {T0} AND {T1}", f"least(max(ts_ns), {T1})"),
)
_add(
    "store_query_latest_all",
    lambda spark, d: _floats(spark, d).query_latest_all("events"),
    f"SELECT event_type AS tag, max(epoch_us(ts) * 1000) AS ts_ns, arg_max({_UP}, ts) AS value FROM events GROUP BY 1",
)
_add(
    "store_expired_days",
    lambda spark, d: _swept(spark, d),
    f"SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns FROM events WHERE epoch_us(ts) * 1000 // 86400000000000 >= {(NOW - 10 * 86_400 * 1_000_000_000) // 86_400_000_000_000}",
)


def _swept(spark: SparkSession, d: str) -> DataFrame:
    db = _floats(spark, d, expiration_min=10 * 1440)
    db.sweep("events", NOW)
    return db.series("events").select("tag", "ts_ns")


def store_structs(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.create_table("items", ColumnAttribute("value", STRUCTURE, structure=[ColumnAttribute("qty", FLOAT), ColumnAttribute("status", STRING), ColumnAttribute("note", STRING)]))
    li = load(spark, d, "lineitem")
    value = F.struct(F.col("l_quantity").alias("qty"), F.col("l_linestatus").alias("status"), F.col("l_tax").alias("undeclared"))
    db.append("items", as_series(li, "l_returnflag", unix_ns(F.col("l_shipdate")), value), NOW)
    got = db.query_all("items", "A", 0, NOW, Condition("qty", ">=", 30), zero_fill=True, now_ns=NOW)
    return got.select("tag", "ts_ns", F.col("value.qty").alias("qty"), F.col("value.status").alias("status"), F.col("value.note").alias("note"))


_add(
    "store_structs",
    store_structs,
    f"SELECT l_returnflag AS tag, epoch_us(l_shipdate) * 1000 AS ts_ns, l_quantity AS qty, l_linestatus AS status, '' AS note FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 30 AND epoch_us(l_shipdate) * 1000 <= {NOW}",
)


def store_adaptive(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.create_table("props", ColumnAttribute("value", UNKNOWN))
    db.append("props", events(spark, d, F.parse_json("props")), NOW)
    got = db.query_all("props", "click", 0, NOW, Condition("k", ">", 50), now_ns=NOW)
    return got.select("tag", "ts_ns", F.try_variant_get("value", "$.k", "bigint").alias("k"))


_add(
    "store_adaptive",
    store_adaptive,
    f"SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) > 50 AND epoch_us(ts) * 1000 <= {NOW}",
)


DAY_NS = 86_400_000_000_000
_ALL = f"SELECT event_id, event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, {_UP} AS value FROM events"


def store_day_edge(spark: SparkSession, d: str) -> DataFrame:
    """Points in the last 90 ns of each day belong to it."""
    db = _database(spark)
    db.create_table("events", ColumnAttribute("value", FLOAT, float_precision=1))
    rows = events(spark, d)
    db.append("events", rows.withColumn("ts_ns", F.col("ts_ns") - F.pmod("ts_ns", F.lit(DAY_NS)) + DAY_NS - 90 + F.pmod("event_id", F.lit(90))), NOW)
    return db.query_all("events", "click", T0, T0 + 3 * DAY_NS - 1, now_ns=NOW)


_add(
    "store_day_edge",
    store_day_edge,
    f"SELECT tag, ts_ns, value FROM (SELECT tag, (ts_ns // {DAY_NS}) * {DAY_NS} + {DAY_NS} - 90 + event_id % 90 AS ts_ns, value FROM ({_ALL})) WHERE tag = 'click' AND ts_ns BETWEEN {T0} AND {T0 + 3 * DAY_NS - 1}",
)


def store_latest_tie(spark: SparkSession, d: str) -> DataFrame:
    """Of equal times the point written last is the latest."""
    db = _floats(spark, d)
    db.append("events", events(spark, d, -F.col("value")), NOW)
    return db.query_latest_all("events")


_add(
    "store_latest_tie",
    store_latest_tie,
    "SELECT event_type AS tag, max(epoch_us(ts) * 1000) AS ts_ns, arg_max(ceil(-value * 10.0::DOUBLE - 1e-9::DOUBLE) / 10.0::DOUBLE, ts) AS value FROM events GROUP BY 1",
)


def store_late_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch is judged against the newest points stored before: what is older than its tag's is late."""
    db = _database(spark)
    db.create_table("events", ColumnAttribute("value", FLOAT, float_precision=1))
    rows = events(spark, d)
    half = (F.col("ts_ns") < (T0 + T1) // 2) & (F.pmod("event_id", F.lit(3)) == 0)
    db.append("events", rows.where(half), NOW)
    db.append("events", rows.where(~half), NOW)
    return db.series("events").select("tag", "ts_ns", "value")


_HALF = f"(ts_ns < {(T0 + T1) // 2} AND event_id % 3 = 0)"
_add(
    "store_late_batches",
    store_late_batches,
    f"""WITH s AS ({_ALL}), n AS (SELECT tag, max(ts_ns) AS newest FROM s WHERE {_HALF} GROUP BY tag)
SELECT tag, ts_ns, value FROM s LEFT JOIN n USING (tag) WHERE {_HALF} OR newest IS NULL OR ts_ns >= newest""",
)


def store_dedup_batches(spark: SparkSession, d: str) -> DataFrame:
    """Minimum interval and value dedup go on from the last kept point of the batches before."""
    db = _database(spark, min_interval_ms=60_000, dedup_ms=3_600_000)
    db.create_table("events", ColumnAttribute("value", FLOAT, float_precision=1))
    rows = events(spark, d, F.floor(F.col("value") / 20).cast("double"))
    for part in (F.col("ts_ns") < T0, F.col("ts_ns").between(T0, T1 - 1), F.col("ts_ns") >= T1):
        db.append("events", rows.where(part), NOW)
    return db.series("events").select("tag", "ts_ns", "value")


_add("store_dedup_batches", store_dedup_batches, _THIN.format(interval=MINUTE, dedup=60 * MINUTE).replace("SELECT event_id, tag, ts_ns, value FROM f", "SELECT tag, ts_ns, value FROM f"))


def _mixed(mode: str | int):
    """An adaptive table in which every fourth value is a text."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        db = _database(spark)
        db.create_table("mixed", ColumnAttribute("value", UNKNOWN, float_precision=1))
        value = F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit("none").cast("variant")).otherwise(F.col("value").cast("variant"))
        db.append("mixed", events(spark, d, value), NOW)
        got = db.query("mixed", "view", T0, T1, 60, mode, now_ns=NOW)
        return got.select("tag", "ts_ns", F.try_variant_get("value", "$", "double").alias("value"), (F.schema_of_variant("value") == "STRING").alias("is_text"))

    return query


_S_MIXED = f"SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, CASE WHEN event_id % 4 <> 0 THEN {_UP} END AS value, event_id AS o FROM events WHERE event_type = 'view'"
for _mode, _name in ((7, "avg"), ("min", "min"), (2, "max")):
    _add(f"store_downsample_adaptive_{_name}", _mixed(_mode), "SELECT *, value IS NULL AS is_text FROM (" + chain_sql(_S_MIXED, 60, _name, f"s.ts_ns BETWEEN {T0} AND {T1}", f"least(max(ts_ns), {T1})") + ")")


def batch_write_count(spark: SparkSession, d: str) -> DataFrame:
    """How many points of each tag a batch wrote, counted in the table."""
    db = _database(spark)
    db.create_table("events", ColumnAttribute("value", FLOAT, float_precision=1))
    odd = F.when(F.pmod("event_id", F.lit(11)) != 0, F.col("value"))
    batch = db.append("events", events(spark, d, odd), NOW, strict=False)
    return db.series("events").where(F.col("batch") == batch).groupBy("tag").agg(F.count(F.lit(1)).alias("written"))


_add("batch_write_count", batch_write_count, f"SELECT event_type AS tag, count(*) AS written FROM events WHERE value IS NOT NULL AND isfinite(value) AND event_id % 11 <> 0 AND epoch_us(ts) * 1000 <= {2 * NOW} GROUP BY 1")


def store_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Compaction changes neither rows nor which of equal times arrived last."""
    db = _floats(spark, d)
    db.append("events", events(spark, d, -F.col("value")), NOW)
    db.compact("events")
    return db.series("events").select("tag", "ts_ns", "value")


_add(
    "store_compacted",
    store_compacted,
    f"""WITH s AS ({_ALL}), n AS (SELECT tag, max(ts_ns) AS newest FROM s GROUP BY tag)
SELECT tag, ts_ns, value FROM s UNION ALL
SELECT event_type, epoch_us(ts) * 1000, ceil(-value * 10.0::DOUBLE - 1e-9::DOUBLE) / 10.0::DOUBLE FROM events JOIN n ON tag = event_type WHERE epoch_us(ts) * 1000 >= newest""",
)


def stream_replayed(spark: SparkSession, d: str) -> DataFrame:
    """A micro-batch that is written again takes the place of what it wrote before."""
    db = _database(spark)
    db.create_table("events", ColumnAttribute("value", FLOAT, float_precision=1))
    rows = events(spark, d)
    for number in (0, 1, 1, 0, 2):
        store_batch(db, "events", rows.where(F.pmod("event_id", F.lit(3)) == number), f"query-{number}", NOW)
    return db.series("events").select("tag", "ts_ns", "value")


_add("stream_replayed", stream_replayed, f"SELECT tag, ts_ns, value FROM ({_ALL})")


def _event_stream(spark: SparkSession, d: str, value) -> DataFrame:
    schema = load(spark, d, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    return as_series(source, "event_type", unix_ns(F.col("ts")), value)


def _drain(frame: DataFrame) -> DataFrame:
    """Run a stream over what there is, into a table in the shared folder."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = frame.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    out.format("parquet").start(f"{at}/out").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{at}/out")


_add(
    "stream_thin_and_dedup",
    lambda spark, d: _drain(kept_stream(_event_stream(spark, d, F.floor(F.col("value") / 20).cast("double")), MINUTE, 60 * MINUTE)),
    _THIN.format(interval=MINUTE, dedup=60 * MINUTE).replace("SELECT event_id, tag, ts_ns, value FROM f", "SELECT tag, ts_ns, value FROM f"),
)
_add(
    "stream_windows",
    lambda spark, d: _drain(windowed(_event_stream(spark, d, F.col("value")), "10 minutes", "1 day")).select("tag", F.unix_micros("start").alias("start_us"), "n", "min", "max"),
    # a window comes out once the watermark, ten minutes behind the newest event, has passed its end
    """SELECT * FROM (SELECT event_type AS tag, epoch_us(ts) // 86400000000 * 86400000000 AS start_us, count(value) AS n, min(value) AS "min", max(value) AS "max" FROM events GROUP BY 1, 2)
WHERE start_us + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""",
)
