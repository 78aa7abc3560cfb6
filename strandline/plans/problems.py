"""Queries of the general problems over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.operators import heavy_keys, regular_grid, schema_drift, spikes
from strandline.session import load

HEAVY_PERCENT = 3


def _wal_keys(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.per_key(load(spark, d, "wal_entries"), "tag_key", "ts_ns", "entry_id", "val").where("tag_key != 0")


def _header_keys(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.per_key(load(spark, d, "segment_headers"), "attr_code", "max_time", "block_id", "segment_file").where(
        "attr_code != 0"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = F.col("n") * 100 >= F.col("total") * HEAVY_PERCENT
    wal = _wal_keys(spark, d).where(heavy).select(F.lit("wal_entries").alias("tbl_name"), "tag_key")
    headers = _header_keys(spark, d).where(heavy).select(F.lit("segment_headers").alias("tbl_name"), F.col("attr_code").alias("tag_key"))
    return wal.unionByName(headers)


def p1_wal_keys(spark: SparkSession, d: str) -> DataFrame:
    return _wal_keys(spark, d).select("tag_key", "n", "first_ts", "last_ts", F.col("latest").alias("latest_val"))


def p1_header_keys(spark: SparkSession, d: str) -> DataFrame:
    return _header_keys(spark, d).select("attr_code", "n", F.col("first_ts").alias("first_max"), F.col("last_ts").alias("last_max"), F.col("latest").alias("latest_file"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.readings(*(load(spark, d, t) for t in ("points", "segment_headers", "tag_dictionary")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_series(_readings(spark, d), within_day=True).where("n = 0").select("tag_key", "slot_ns")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_series(_readings(spark, d))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(load(spark, d, "tag_points"), load(spark, d, "tag_dictionary"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("row_id")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    return spikes.peaks(load(spark, d, "tag_points"), load(spark, d, "tag_dictionary"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(load(spark, d, "schema_files"), load(spark, d, "raw_records")).drop("tbl_name", "written_ns")


def p6_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The whole edit scripts, moves and renamings of structures included."""
    return schema_drift.scripts(load(spark, d, "schema_files"), load(spark, d, "raw_records")).drop("tbl_name", "written_ns")


def p6_projections(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.projections(load(spark, d, "schema_files"), load(spark, d, "raw_records"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """Which records are in the consistent tables, and which of them can be read."""
    return schema_drift.consistent_table(load(spark, d, "schema_files"), load(spark, d, "raw_records")).drop("fields")


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    rows = schema_drift.consistent_table(load(spark, d, "schema_files"), load(spark, d, "raw_records"))
    return rows.withColumn("fields", F.to_json("fields"))


QUERIES = {f.__name__: f for f in (p1_found, p1_wal_keys, p1_header_keys, p3_found, p3_grid, p5_method, p5_found, p5_flags, p6_found, p6_scripts, p6_projections, p6_table, p6_records)}

_PER_KEY = """
SELECT {key}, count(*) AS n, min({time}) AS {first}, max({time}) AS {last},
       (arg_max(struct_pack(v := {value}), struct_pack(t := {time}, o := {order}))).v AS {latest}
FROM {table} WHERE {key} IS NOT NULL AND {key} <> 0 GROUP BY {key}
"""
_READINGS = """
WITH r AS (
  SELECT attr_code AS tag_key, period_s * 1000000000 AS step, v + 0.0::DOUBLE AS v, point_id,
         CASE WHEN abs(tms) < 100000000000 THEN tms * 1000000000 WHEN abs(tms) < 100000000000000 THEN tms * 1000000
              WHEN abs(tms) < 100000000000000000 THEN tms * 1000 ELSE tms END AS at_ns
  FROM points JOIN segment_headers USING (block_id) JOIN tag_dictionary t ON t.tag_key = attr_code
  WHERE attr_code IS NOT NULL AND attr_code <> 0 AND v IS NOT NULL AND isfinite(v) AND period_s > 0),
s AS (
  SELECT tag_key, step, (at_ns // step) * step AS slot_ns, count(*) AS n,
         arg_max(v, struct_pack(a := at_ns, b := point_id)) AS v
  FROM r GROUP BY ALL),
d AS (
  SELECT tag_key, step, slot_ns // 86400000000000 AS day, min(slot_ns) AS a, max(slot_ns) AS z FROM s GROUP BY ALL),
g AS (SELECT tag_key, step, day, unnest(range(a, z + 1, step)) AS slot_ns FROM d),
f AS (SELECT g.tag_key, g.step, g.day, g.slot_ns, coalesce(s.n, 0) AS n, s.v,
       last_value(CASE WHEN s.n IS NOT NULL THEN g.slot_ns END IGNORE NULLS) OVER w AS seen,
       last_value(s.v IGNORE NULLS) OVER w AS seen_v
  FROM g LEFT JOIN s USING (tag_key, step, slot_ns)
  WINDOW w AS (PARTITION BY g.tag_key, g.day ORDER BY g.slot_ns))
"""
# The rules over whole series. The usual scatter is taken from the operator's bins of magnitude, 32 to a doubling: from the median magnitude on, six times over.
_P5 = """
WITH r AS (
  SELECT row_id, tag, ts_ns, val FROM tag_points WHERE tag IS NOT NULL AND ts_ns IS NOT NULL AND val IS NOT NULL AND NOT isnan(val)),
x AS (SELECT tag, ts_ns, greatest(least(arg_min(val, row_id), 1e150), -1e150) AS v FROM r GROUP BY tag, ts_ns),
l AS (
  SELECT tag, ts_ns, v, row_number() OVER o AS i, count(*) OVER (PARTITION BY tag) AS len, coalesce(abs(v - lag(v) OVER o) <= 0.000001, false) AS same,
    v - median(v) OVER (o ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS r,
    median(v) OVER (o ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS mb, median(v) OVER (o ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS ma
  FROM x WINDOW o AS (PARTITION BY tag ORDER BY ts_ns)),
h AS (
  SELECT tag, e, count(*)::DOUBLE AS n, sum(r) AS s, sum(r * r) AS q
  FROM (SELECT tag, r, CASE WHEN r = 0 THEN 0 ELSE pow(2, (floor(log2(abs(r)) * 32) + 1) / 32) END AS e FROM l) GROUP BY tag, e),
c AS (SELECT tag, e, sum(n) OVER (PARTITION BY tag ORDER BY e) AS upto, sum(n) OVER (PARTITION BY tag) AS total FROM h),
s0 AS (SELECT tag, 1.4826 * min(e) AS s FROM c WHERE upto >= 0.5 * total GROUP BY tag),
"""
_P5 += "".join(
    f"s{k} AS (SELECT tag, sqrt(greatest(0, sum(h.q) / sum(h.n) - pow(sum(h.s) / sum(h.n), 2))) AS s FROM h JOIN s{k - 1} p USING (tag) WHERE e <= 4 * p.s GROUP BY tag),\n" for k in range(1, 7)
)
_P5 += """
u AS (SELECT tag, coalesce(s6.s, s0.s) AS s FROM s0 LEFT JOIN s6 USING (tag)),
t AS (SELECT tag, avg(same::INT) FILTER (WHERE i > 1) AS still FROM l GROUP BY tag),
o AS (SELECT l.*, u.s, abs(l.r) > 9 * u.s AND abs(l.r) > 0.000001 AS far FROM l JOIN u USING (tag)),
g AS (
  SELECT *, sum(1 - far::INT) OVER w AS spike_run, sum(1 - same::INT) OVER w AS still_run FROM o WINDOW w AS (PARTITION BY tag ORDER BY ts_ns)),
k AS (
  SELECT tag, spike_run FROM (SELECT *, first(mb ORDER BY ts_ns) OVER p AS b, last(ma ORDER BY ts_ns) OVER p AS a FROM g WHERE far
    WINDOW p AS (PARTITION BY tag, spike_run ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  GROUP BY tag, spike_run
  HAVING count(*) <= 3 AND min(i) > 1 AND max(i) < any_value(len)
     AND bool_and(abs(v - b) > 9 * s AND abs(v - a) > 9 * s AND (v - b) * (v - a) > 0)),
y AS (
  SELECT g.tag, g.ts_ns, coalesce(g.v < d.phys_min, false) OR coalesce(g.v > d.phys_max, false) AS impossible,
    count(*) OVER (PARTITION BY g.tag, still_run) >= 12 AND coalesce(t.still, 0) < 0.5 AS stuck, g.far AND k.tag IS NOT NULL AS spike
  FROM g LEFT JOIN t USING (tag) LEFT JOIN tag_dictionary d USING (tag) LEFT JOIN k ON k.tag = g.tag AND k.spike_run = g.spike_run),
z AS (SELECT r.row_id, r.tag, impossible, stuck, spike FROM r JOIN y USING (tag, ts_ns) WHERE impossible OR stuck OR spike)
"""

ORACLES = {
    "p5_found": _P5 + "SELECT row_id FROM z",
    "p5_flags": _P5 + "SELECT row_id, tag, impossible, stuck, spike FROM z",
    "p6_records": """SELECT record_id, raw_records.file_id, tbl_name, coalesce(json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT', false) AS readable
FROM raw_records LEFT JOIN schema_files USING (file_id) WHERE raw_records.file_id IS NOT NULL""",
    "p1_found": """
SELECT 'wal_entries' AS tbl_name, tag_key FROM wal_entries GROUP BY tag_key
HAVING tag_key IS NOT NULL AND tag_key <> 0 AND count(*) * 100 >= 3 * (SELECT count(*) FROM wal_entries)
UNION ALL
SELECT 'segment_headers', attr_code FROM segment_headers GROUP BY attr_code
HAVING attr_code IS NOT NULL AND attr_code <> 0 AND count(*) * 100 >= 3 * (SELECT count(*) FROM segment_headers)""",
    "p1_wal_keys": _PER_KEY.format(key="tag_key", time="ts_ns", order="entry_id", value="val", table="wal_entries", first="first_ts", last="last_ts", latest="latest_val"),
    "p1_header_keys": _PER_KEY.format(key="attr_code", time="max_time", order="block_id", value="segment_file", table="segment_headers", first="first_max", last="last_max", latest="latest_file"),
    "p3_found": _READINGS + "SELECT tag_key, slot_ns FROM f WHERE n = 0",
    "p3_grid": _READINGS + """,
wg AS (SELECT tag_key, step, unnest(range(min(slot_ns), max(slot_ns) + 1, step)) AS slot_ns FROM s GROUP BY tag_key, step),
wf AS (SELECT wg.tag_key, wg.step, wg.slot_ns, coalesce(s.n, 0) AS n,
       last_value(CASE WHEN s.n IS NOT NULL THEN wg.slot_ns END IGNORE NULLS) OVER w AS seen,
       last_value(s.v IGNORE NULLS) OVER w AS seen_v
  FROM wg LEFT JOIN s USING (tag_key, step, slot_ns)
  WINDOW w AS (PARTITION BY wg.tag_key ORDER BY wg.slot_ns))
SELECT tag_key, slot_ns, n, CASE WHEN (slot_ns - seen) // step <= 3 THEN seen_v END AS value,
       CASE WHEN n > 0 THEN 'observed' WHEN (slot_ns - seen) // step <= 3 THEN 'filled' ELSE 'missing' END AS state
FROM wf""",
}
