"""Queries of the series engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.functions.predicates import Condition, all_of, any_of
from strandline.functions.quantize import quantize
from strandline.operators import ingest, reads
from strandline.operators.downsample import HOUR_NS, downsample, downsample_first
from strandline.session import load, materialize
from strandline.sources.series import as_series, unix_ns
from strandline.sources.store import dispatch

#: Fixed instants in Unix ns (2024-01-05, 2024-01-20; the present of queries that need one).
T0, T1, NOW = 1_704_412_800_000_000_000, 1_705_708_800_000_000_000, 1_706_000_000_000_000_000
MINUTE = 60 * 1_000_000_000


def events(spark: SparkSession, d: str, value=None) -> DataFrame:
    e = load(spark, d, "events")
    return as_series(e, "event_type", unix_ns(F.col("ts")), F.col("value") if value is None else value, "event_id")


def lineitems(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    order = (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("k")
    return as_series(li, "l_returnflag", unix_ns(F.col("l_shipdate")), F.col("l_quantity"), order)


def _structs(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    value = F.struct(
        F.col("l_quantity").alias("qty"),
        F.struct(F.col("l_discount").alias("discount"), F.struct(F.col("l_tax").alias("tax")).alias("rates")).alias("price"),
        F.col("l_linestatus").alias("status"),
    )
    return as_series(li, "l_returnflag", unix_ns(F.col("l_shipdate")), value, (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("k"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, F.parse_json("props"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("event_id", "tag", "ts_ns", "value")


def _scan(predicate=None, **kw):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _out(reads.range_scan(events(spark, d), predicate=predicate, **kw))

    return query


_EVENTS = "WITH s AS (SELECT event_id, event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, value FROM events) SELECT event_id, tag, ts_ns, value FROM s"
_STRUCT = "SELECT l_orderkey * 16 + l_linenumber AS k, l_returnflag AS tag FROM lineitem"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_add("range_scan_raw", _scan(tag="click", start=T0, end=T1), f"{_EVENTS} WHERE tag = 'click' AND ts_ns BETWEEN {T0} AND {T1}")
_add("sequential_scan_all", _scan(), _EVENTS)
for _name, _op in {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    _add(
        f"filter_{_name}",
        lambda spark, d, op=_op: reads.range_scan(lineitems(spark, d), tag="R", predicate=Condition("", op, 24)),
        f"SELECT l_returnflag AS tag, epoch_us(l_shipdate) * 1000 AS ts_ns, l_quantity AS value, l_orderkey * 16 + l_linenumber AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity {_op} 24",
    )
_add(
    "filter_and",
    _scan(all_of(Condition("", ">", 20.0), Condition("", "<=", 60.0))),
    f"{_EVENTS} WHERE value > 20 AND value <= 60",
)
_add("filter_or", _scan(any_of(Condition("", "<", 5.0), Condition("", ">", 90.0))), f"{_EVENTS} WHERE value < 5 OR value > 90")
_add(
    "filter_nested",
    _scan(any_of(Condition("", "<", 3.0), all_of(Condition("", ">", 50.0), any_of(Condition("", "<", 52.0), Condition("", ">=", 95.0))))),
    f"{_EVENTS} WHERE value < 3 OR (value > 50 AND (value < 52 OR value >= 95))",
)
_add("filter_nil", _scan(None, tag="purchase"), f"{_EVENTS} WHERE tag = 'purchase'")
_add(
    "filter_strict",
    _scan(all_of(Condition("", ">", 20.0), any_of(Condition("", "<", 30.0), Condition("", ">", 70.0))), strict=True),
    f"{_EVENTS} WHERE value > 20 AND (value < 30 OR value > 70)",
)


def range_inclusive_bounds(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d)
    edge = s.groupBy("tag").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("z"))
    return _out(reads.range_scan(s.join(edge, "tag"), F.col("a"), F.col("z")))


_add(
    "range_inclusive_bounds",
    range_inclusive_bounds,
    "SELECT event_id, event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, value FROM events",
)


def _string_filter(op: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        o = load(spark, d, "orders")
        s = as_series(o, "o_orderpriority", unix_ns(F.col("o_orderdate")), F.col("o_orderstatus"), "o_orderkey")
        return reads.range_scan(s, predicate=Condition("", op, "F")).select("o_orderkey", "tag", "value")

    return query


for _name, _op in (("eq", "="), ("ne", "!=")):
    _add(
        f"filter_string_{_name}",
        _string_filter(_op),
        f"SELECT o_orderkey, o_orderpriority AS tag, o_orderstatus AS value FROM orders WHERE o_orderstatus {_op} 'F'",
    )


def _struct_filter(predicate, **kw):
    return lambda spark, d: reads.range_scan(_structs(spark, d), predicate=predicate, **kw).select("k", "tag")


_add(
    "filter_struct_path",
    _struct_filter(all_of(Condition("price.rates.tax", ">=", 0.06), Condition("status", "=", "O"))),
    f"{_STRUCT} WHERE l_tax >= 0.06 AND l_linestatus = 'O'",
)
_add("filter_path_to_scalar_prefix", _struct_filter(Condition("qty.unit.name", ">", 45.0)), f"{_STRUCT} WHERE l_quantity > 45")
_add("filter_path_on_map", _struct_filter(any_of(Condition("price", "=", 1.0), Condition("qty", "=", 7.0))), f"{_STRUCT} WHERE l_quantity = 7")
_add("filter_missing_path", _struct_filter(any_of(Condition("price.nothing", "=", 1.0), Condition("qty", "<", 3.0))), f"{_STRUCT} WHERE l_quantity < 3")


def _json_filter(predicate):
    return lambda spark, d: reads.range_scan(_variants(spark, d), predicate=predicate).select("event_id", "tag")


_JSON = "SELECT event_id, event_type AS tag FROM events WHERE "
_add("filter_json_path", _json_filter(Condition("k", ">", 50)), _JSON + "CAST(json_extract(props, '$.k') AS BIGINT) > 50")
_add("filter_json_prefix", _json_filter(Condition("k.deep.er", "<=", 10)), _JSON + "CAST(json_extract(props, '$.k') AS BIGINT) <= 10")


def list_values(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    s = as_series(e, F.col("label"), F.col("vec_id"), F.col("embedding"), "vec_id")
    first = e.where("vec_id = 1").select(F.col("embedding").alias("x")).first()
    return reads.range_scan(s, predicate=Condition("", "!=", list(first["x"]) if first else [0.0])).select("vec_id", "tag")


_add(
    "filter_list_ne",
    list_values,
    "SELECT vec_id, CAST(label AS VARCHAR) AS tag FROM embeddings WHERE embedding <> (SELECT embedding FROM embeddings WHERE vec_id = 1)",
)


def expiration_clamp(spark: SparkSession, d: str) -> DataFrame:
    start, end = reads.clamp(0, 2 * NOW, NOW, 7 * 86_400 * 1_000_000_000)
    return _out(reads.range_scan(events(spark, d), start, end))


_WEEK = 7 * 86_400 * 1_000_000_000
_add("expiration_clamp", expiration_clamp, f"{_EVENTS} WHERE ts_ns >= {NOW - _WEEK} AND ts_ns <= {NOW + _WEEK}")


def query_short_span_raw(spark: SparkSession, d: str) -> DataFrame:
    return dispatch(events(spark, d), "click", T0, T0 + HOUR_NS, 1, "avg", order="event_id").select("tag", "ts_ns", "value")


_add(
    "query_short_span_raw",
    query_short_span_raw,
    f"WITH s AS ({_EVENTS}) SELECT tag, ts_ns, value FROM s WHERE tag = 'click' AND ts_ns BETWEEN {T0} AND {T0 + HOUR_NS}",
)


# --- folds: one recursive query for all -----------------------------------------------------------------------------

_CHAIN = """
WITH RECURSIVE s AS ({series}),
e AS (SELECT tag, {until} AS until FROM s GROUP BY tag),
p AS (SELECT s.tag, s.ts_ns, s.value, e.until, row_number() OVER (PARTITION BY s.tag ORDER BY s.ts_ns, s.o) AS i
      FROM s JOIN e USING (tag) WHERE {where}),
f AS (
  SELECT tag, i, until, ts_ns AS last, (until - ts_ns) // {m} AS width, ts_ns AS tt, value AS tv, 1::BIGINT AS c, 0::BIGINT AS n,
         NULL::BIGINT AS et, NULL::DOUBLE AS ev, false AS emit, {m} <= 0 AS full_up
  FROM p WHERE i = 1
  UNION ALL
  SELECT f.tag, p.i, f.until,
    CASE WHEN w.fresh THEN p.ts_ns ELSE f.last END,
    CASE WHEN w.fresh THEN CASE WHEN {m} - f.n > 0 THEN (f.until - p.ts_ns) // ({m} - f.n) ELSE f.width END ELSE f.width END,
    CASE WHEN w.fresh THEN p.ts_ns ELSE {agg_t} END,
    CASE WHEN w.fresh THEN p.value ELSE {agg_v} END,
    CASE WHEN w.fresh THEN 1 ELSE f.c + CASE WHEN {num} THEN 1 ELSE 0 END END,
    f.n + CASE WHEN w.fresh THEN 1 ELSE 0 END,
    CASE WHEN w.fresh THEN f.tt END, CASE WHEN w.fresh THEN f.tv END, w.fresh,
    w.fresh AND f.n + 1 >= {m} - 1
  FROM f JOIN p ON p.tag = f.tag AND p.i = f.i + 1, LATERAL (SELECT p.ts_ns - f.last >= f.width AS fresh) w
  WHERE NOT f.full_up),
z AS (SELECT tag, max(i) AS i FROM f GROUP BY tag)
SELECT tag, et AS ts_ns, ev AS value FROM f WHERE emit
UNION ALL
SELECT f.tag, tt, tv FROM f JOIN z USING (tag, i)"""
_NUM = "f.tv IS NOT NULL AND p.value IS NOT NULL"
_AGG = {
    "avg": (
        f"CASE WHEN {_NUM} THEN f.tt + (p.ts_ns - f.tt) // (f.c + 1) ELSE f.tt END",
        f"CASE WHEN {_NUM} THEN f.tv + (p.value - f.tv) / (f.c + 1) ELSE f.tv END",
    ),
    "min": (f"CASE WHEN {_NUM} AND p.value < f.tv THEN p.ts_ns ELSE f.tt END", f"CASE WHEN {_NUM} AND p.value < f.tv THEN p.value ELSE f.tv END"),
    "max": (f"CASE WHEN {_NUM} AND p.value > f.tv THEN p.ts_ns ELSE f.tt END", f"CASE WHEN {_NUM} AND p.value > f.tv THEN p.value ELSE f.tv END"),
    "first": ("f.tt", "f.tv"),
}
_S_EVENTS = "SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, value, event_id AS o FROM events"
_S_LINES = "SELECT l_returnflag AS tag, epoch_us(l_shipdate) * 1000 AS ts_ns, l_quantity AS value, l_orderkey * 16 + l_linenumber AS o FROM lineitem"


def chain_sql(series: str, m: int, mode: str, where: str = "true", until: str = "max(ts_ns)") -> str:
    t, v = _AGG[mode]
    return _CHAIN.format(series=series, m=m, agg_t=t, agg_v=v, where=where, until=until, num=_NUM)


def _down(m: int, mode: str, where=None, **kw):
    return lambda spark, d: downsample(events(spark, d), m, mode, where=where, order="event_id", **kw)


for _mode in ("avg", "min", "max"):
    _add(f"downsample_{_mode}", _down(50, _mode), chain_sql(_S_EVENTS, 50, _mode))
for _m in (1, 2):
    _add(f"downsample_budget_{_m}", _down(_m, "avg"), chain_sql(_S_EVENTS, _m, "avg"))
_add("downsample_filtered", _down(50, "avg", "value > 20"), chain_sql(_S_EVENTS, 50, "avg", "s.value > 20"))
_add(
    "downsample_range",
    _down(100, "max", start=T0, end=T1),
    chain_sql(_S_EVENTS, 100, "max", f"s.ts_ns BETWEEN {T0} AND {T1}", f"least(max(ts_ns), {T1})"),
)
_add("downsample_default_budget", _down(0, "avg"), chain_sql(_S_EVENTS, 10_000, "avg"))
_add("downsample_ties", lambda spark, d: downsample(lineitems(spark, d), 60, "max", order="k"), chain_sql(_S_LINES, 60, "max"))


def downsample_mixed(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 3 != 0, F.col("value"))  # every third value is no number
    return downsample(events(spark, d, odd), 40, "avg", order="event_id")


_add("downsample_non_numeric", downsample_mixed, chain_sql(_S_EVENTS.replace(" value,", " CASE WHEN event_id % 3 <> 0 THEN value END AS value,"), 40, "avg"))


def downsample_structs(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d, F.struct("value", "user_id"))
    return downsample_first(s, 40, "event_id").select("tag", "ts_ns", F.col("value.value").alias("value"))


_add(
    "downsample_structs",
    downsample_structs,
    f"WITH q AS ({chain_sql(_S_EVENTS, 40, 'first')}), x AS ({_S_EVENTS}) SELECT q.tag, q.ts_ns, arg_min(x.value, x.o) AS value FROM q JOIN x USING (tag, ts_ns) GROUP BY q.tag, q.ts_ns",
)


# --- latest, dictionary, retention -----------------------------------------------------------------------------------

_add(
    "latest_per_tag",
    lambda spark, d: reads.latest(lineitems(spark, d), "k").drop("k"),
    f"SELECT tag, max(ts_ns) AS ts_ns, arg_max(value, struct_pack(a := ts_ns, b := o)) AS value FROM ({_S_LINES}) GROUP BY tag",
)
_add(
    "latest_one",
    lambda spark, d: reads.latest(events(spark, d).where("tag = 'click'"), "event_id").drop("event_id"),
    f"SELECT tag, ts_ns, value FROM ({_S_EVENTS}) WHERE tag = 'click' ORDER BY ts_ns DESC, o DESC LIMIT 1",
)
_add(
    "tag_dictionary_codes",
    lambda spark, d: reads.tag_dictionary(events(spark, d), "event_id"),
    "SELECT tag, row_number() OVER (ORDER BY f, tag) AS code FROM (SELECT event_type AS tag, min(event_id) AS f FROM events GROUP BY 1)",
)
_add(
    "retention_cutoff",
    lambda spark, d: _out(reads.retained(events(spark, d), NOW, 10 * 86_400 * 1_000_000_000)),
    f"{_EVENTS} WHERE ts_ns >= {NOW - 10 * 86_400 * 1_000_000_000}",
)


def _placed(df: DataFrame) -> DataFrame:
    """``df`` as it lies, with each row's partition and its place in that (from 0)."""
    laid = materialize(df.withColumn("id", F.monotonically_increasing_id()), "laid")
    return laid.withColumn("part", F.shiftright("id", 33)).withColumn("place", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))


def raw_ordering(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a tag with their position in the sorted result, counted from the partitions' sizes."""
    rows = _placed(reads.range_scan(events(spark, d), T0, T1, "view").orderBy("ts_ns", "event_id"))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = parts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))  # a row per partition
    return rows.join(before, "part").select("event_id", "tag", "ts_ns", "value", (F.col("before") + F.col("place") + 1).alias("position"))


_add(
    "raw_ordering",
    raw_ordering,
    f"SELECT *, row_number() OVER (ORDER BY ts_ns, event_id) AS position FROM ({_EVENTS}) WHERE tag = 'view' AND ts_ns BETWEEN {T0} AND {T1}",
)

# --- ingest ------------------------------------------------------------------------------------------------------------

_add(
    "quantize_float",
    lambda spark, d: load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quantize(F.col("l_extendedprice") / 7, 2).alias("v")),
    "SELECT l_orderkey, l_linenumber, ceil(l_extendedprice / 7 * 100.0::DOUBLE - 1e-9::DOUBLE) / 100.0::DOUBLE AS v FROM lineitem",
)
_add(
    "future_guard",
    lambda spark, d: _out(ingest.guards(events(spark, d), T1, 3600 * 1_000_000_000)),
    f"{_EVENTS} WHERE ts_ns <= {T1 + 3600 * 1_000_000_000} AND value IS NOT NULL AND isfinite(value)",
)
_add(
    "empty_guard",
    lambda spark, d: _out(ingest.guards(events(spark, d, F.when(F.col("event_id") % 5 != 0, F.col("value"))), NOW)),
    f"{_EVENTS} WHERE event_id % 5 <> 0 AND isfinite(value)",
)
_add(
    "late_drop",
    lambda spark, d: ingest.drop_late(events(spark, d).withColumn("tag", F.concat(F.lit("user"), F.col("event_id") % 50)).withColumn("ts_ns", F.col("ts_ns") - (F.col("event_id") % 7) * 30 * MINUTE), "event_id", 1000).select("event_id", "tag", "ts_ns"),
    f"""WITH s AS (SELECT event_id, 'user' || event_id % 50 AS tag, epoch_us(ts) * 1000 - event_id % 7 * {30 * MINUTE} AS ts_ns FROM events),
w AS (SELECT *, max(ts_ns) OVER (PARTITION BY tag ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s)
SELECT event_id, tag, ts_ns FROM w WHERE h IS NULL OR ts_ns >= h""",
)

_THIN = """
WITH RECURSIVE s AS (SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, floor(value / 20) AS value, event_id FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts_ns, event_id) AS i FROM s),
f AS (
  SELECT tag, i, event_id, ts_ns, value, ts_ns AS lt, value AS lv, true AS keep FROM p WHERE i = 1
  UNION ALL
  SELECT f.tag, p.i, p.event_id, p.ts_ns, p.value,
         CASE WHEN k.keep THEN p.ts_ns ELSE f.lt END, CASE WHEN k.keep THEN p.value ELSE f.lv END, k.keep
  FROM f JOIN p ON p.tag = f.tag AND p.i = f.i + 1,
       LATERAL (SELECT NOT (p.ts_ns - f.lt < {interval}) AND NOT ({dedup} > 0 AND p.ts_ns - f.lt <= {dedup} AND p.value = f.lv) AS keep) k)
SELECT event_id, tag, ts_ns, value FROM f WHERE keep"""


def _thinned(interval: int, dedup: int):
    return lambda spark, d: _out(ingest.thin(events(spark, d, F.floor(F.col("value") / 20).cast("double")), interval, dedup, order="event_id"))


_add("min_interval_thin", _thinned(30 * MINUTE, 0), _THIN.format(interval=30 * MINUTE, dedup=0))
_add("dedup_window", _thinned(0, 60 * MINUTE), _THIN.format(interval=0, dedup=60 * MINUTE))
_add("thin_and_dedup", _thinned(MINUTE, 60 * MINUTE), _THIN.format(interval=MINUTE, dedup=60 * MINUTE))


def zero_fill_struct(spark: SparkSession, d: str) -> DataFrame:
    p = F.parse_json("props")
    value = F.struct(F.try_variant_get(p, "$.k", "bigint").alias("k"), F.try_variant_get(p, "$.none", "string").alias("name"), F.try_variant_get(p, "$.x", "double").alias("x"))
    e = ingest.zero_fill(events(spark, d, value))
    return e.select("event_id", F.col("value.k").alias("k"), F.col("value.name").alias("name"), F.col("value.x").alias("x"))


_add(
    "zero_fill_struct",
    zero_fill_struct,
    "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, '' AS name, 0.0::DOUBLE AS x FROM events",
)
_add(
    "type_evolution_float",
    lambda spark, d: ingest.evolve(events(spark, d, F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id")))), "value", "float")[0].select("event_id", "value"),
    "SELECT event_id, event_id::DOUBLE AS value FROM events WHERE event_id % 2 = 0",
)


def reorder_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each row with its place among its tag's rows as they lie after reordering; a tag lies in one partition."""
    rows = _placed(ingest.reorder(events(spark, d), "event_id"))
    first = rows.groupBy("tag").agg(F.min("place").alias("first"), F.min("part").alias("part"))
    return rows.join(first, ["tag", "part"]).select("event_id", "tag", "ts_ns", "value", (F.col("place") - F.col("first") + 1).alias("position"))


_add("reorder_batch", reorder_batch, f"SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts_ns, event_id) AS position FROM ({_EVENTS})")
