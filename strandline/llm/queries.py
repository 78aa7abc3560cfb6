"""Queries and SQL of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.llm import encode, language, packing, percentiles, runs
from strandline.operators.reads import day_of
from strandline.operators.regular_grid import instant_ns
from strandline.session import load, materialize

PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)


def _values(spark: SparkSession, d: str) -> DataFrame:
    headers = load(spark, d, "segment_headers").where("attr_code is not null and attr_code != 0").select("block_id", "attr_code")
    points = load(spark, d, "points").select("block_id", "v", day_of(instant_ns(F.col("tms"))).alias("day"))
    return points.join(headers, "block_id")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    got = percentiles.radix_percentiles(_values(spark, d).select("attr_code", "v"), "attr_code", "v", PROBS)
    return got.select("attr_code", "q", "n", F.col("low").alias("value"))


def p2_day_summaries(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.day_summaries(_values(spark, d), "attr_code", "v", "day")


def p2_from_days(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles_from_summaries(p2_day_summaries(spark, d), "attr_code", PROBS)


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return runs.collapse_runs(load(spark, d, "wal_entries"), "tag_key", "ts_ns", "val", "entry_id", least=least)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select("tag_key", "start_ns", "end_ns")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 1)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(load(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(materialize(encode.count_tokens(load(spark, d, "documents")), "tokens"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold: whether each document is in them once and whole, no container is overfull and no two pieces overlap, and the share filled."""
    rows = materialize(p8_containers(spark, d), "containers")
    docs = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("upto"))
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY))
    per_doc = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(((F.col("n") != F.col("upto")) | (F.col("pieces") != split)).cast("long")).alias("broken"))
    order = Window.partitionBy("container_id").orderBy("container_offset")  # at most as many rows as a container has tokens
    placed = rows.where("container_id is not null").withColumn("next", F.coalesce(F.lead("container_offset").over(order), F.lit(packing.CAPACITY)))
    per_box = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max((F.col("container_offset") + F.col("n_tokens") > F.col("next")).cast("long")).alias("over"))
    boxes = per_box.agg(F.sum("over").alias("overlaps"), F.sum((F.col("n") > packing.CAPACITY).cast("long")).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
    boxes = boxes.withColumn("fill", F.col("tokens") / (F.col("containers") * packing.CAPACITY))
    both = per_doc.unionByName(boxes, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    return p8_fill(spark, d).select("documents", "broken", "overlaps", "overfull", (F.col("containers") <= 1.01 * F.ceil(F.col("tokens") / packing.CAPACITY) + 1).alias("well_filled"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return language.assign_languages(docs, language.fit(docs))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(_languages(spark, d).where("numbered"), "languages")
    main = rows.where("para_no = 0")
    wrong = main.where("label is null or label != lang").select("doc_id", F.lit(0).cast("long").alias("para_no"), "lang")
    other = (
        rows.where("para_no > 0")
        .join(main.select("doc_id", F.col("lang").alias("main")), "doc_id")
        .where("lang != main")
        .select("doc_id", "para_no", "lang")
    )
    return wrong.unionByName(other).distinct()


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_day_summaries, p2_from_days, p4_found, p4_runs, p7_ids, p8_containers, p8_fill, p8_check, p9_found, p9_languages)}

_P2 = """
WITH v AS (SELECT attr_code, v + 0.0::DOUBLE AS v FROM points JOIN segment_headers USING (block_id)
           WHERE attr_code IS NOT NULL AND attr_code <> 0 AND v IS NOT NULL AND isfinite(v)),
r AS (SELECT attr_code, v, row_number() OVER (PARTITION BY attr_code ORDER BY v) AS k, count(*) OVER (PARTITION BY attr_code) AS n FROM v)
SELECT attr_code, q, n, v AS value FROM r, (SELECT unnest([0.01::DOUBLE, 0.25, 0.5, 0.75, 0.99]) AS q)
WHERE k = greatest(1, ceil(q * n::DOUBLE)::BIGINT)"""
_P4 = """
WITH d AS (
  SELECT tag_key, ts_ns, arg_min(val, entry_id) AS val, min(entry_id) AS entry_id FROM wal_entries
  WHERE tag_key IS NOT NULL AND tag_key <> 0 AND val IS NOT NULL AND ts_ns IS NOT NULL GROUP BY tag_key, ts_ns),
m AS (
  SELECT tag_key, ts_ns, val, CASE WHEN json_type(val) = 'OBJECT' THEN list_sort(json_keys(val)) ELSE [''] END AS ks FROM d),
p AS (
  SELECT tag_key, ts_ns, val, json_type(val) = 'OBJECT' AS obj,
    list_transform(ks, lambda k: struct_pack(
      k := k,
      t := CASE WHEN json_type(val, CASE WHEN k = '' THEN '$' ELSE '$.' || k END) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'NUM'
                ELSE json_type(val, CASE WHEN k = '' THEN '$' ELSE '$.' || k END) END,
      s := lower(trim(json_extract_string(val, CASE WHEN k = '' THEN '$' ELSE '$.' || k END))),
      n := try_cast(json_extract_string(val, CASE WHEN k = '' THEN '$' ELSE '$.' || k END) AS DOUBLE))) AS v
  FROM m),
l AS (
  SELECT *, lag(v) OVER w AS pv, lag(obj) OVER w AS po, lag(ts_ns) OVER w AS pt FROM p WINDOW w AS (PARTITION BY tag_key ORDER BY ts_ns)),
b AS (
  SELECT tag_key, ts_ns, val, CASE WHEN pt IS NOT NULL AND ts_ns - pt <= 600000000000 AND po = obj AND len(pv) = len(v)
    AND len(list_filter(list_zip(pv, v), lambda z: NOT (z[1].k = z[2].k AND z[1].t = z[2].t AND
        CASE WHEN z[1].t = 'NUM' THEN abs(z[1].n - z[2].n) <= 0.001 + 1e-9 ELSE coalesce(z[1].s, '') = coalesce(z[2].s, '') END))) = 0
    THEN 0 ELSE 1 END AS fresh FROM l),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY tag_key ORDER BY ts_ns) AS run FROM b)
"""
_BITS = """
WITH v AS (
  SELECT attr_code, (CASE WHEN abs(tms) < 100000000000 THEN tms * 1000000000 WHEN abs(tms) < 100000000000000 THEN tms * 1000000
                     WHEN abs(tms) < 100000000000000000 THEN tms * 1000 ELSE tms END) // 86400000000000 AS day, (v + 0.0::DOUBLE)::BIT::BIGINT AS b
  FROM points JOIN segment_headers USING (block_id) WHERE attr_code IS NOT NULL AND attr_code <> 0 AND v IS NOT NULL AND isfinite(v)),
o AS (SELECT attr_code, day, CASE WHEN b < 0 THEN xor(b, 9223372036854775807) ELSE b END AS k FROM v),
"""
_AS_DOUBLE = "(CASE WHEN {0} < 0 THEN xor({0}, 9223372036854775807) ELSE {0} END)::BIT::DOUBLE"
ORACLES = {
    "p2_day_summaries": _BITS + "x AS (SELECT attr_code, day, k >> 44 AS digit FROM o) SELECT attr_code, day, digit, count(*) AS n FROM x GROUP BY ALL",
    # the bounds of the digit that the exact percentile has
    "p2_from_days": _BITS + f"""r AS (SELECT attr_code, (k >> 44) * 17592186044416 AS lo, row_number() OVER (PARTITION BY attr_code ORDER BY k) AS i, count(*) OVER (PARTITION BY attr_code) AS n FROM o)
SELECT attr_code, q, n, {_AS_DOUBLE.format('lo')} AS low, {_AS_DOUBLE.format('(lo + 17592186044415)')} AS high
FROM r, (SELECT unnest([0.01::DOUBLE, 0.25, 0.5, 0.75, 0.99]) AS q) WHERE i = greatest(1, ceil(q * n::DOUBLE)::BIGINT)""",
    "p8_check": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS broken, 0::BIGINT AS overlaps, 0::BIGINT AS overfull, true AS well_filled FROM documents",
    "p2_percentiles": _P2,
    "p4_found": _P4 + "SELECT tag_key, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM r GROUP BY tag_key, run HAVING count(*) >= 2",
    "p4_runs": _P4 + """SELECT tag_key, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n, max(ts_ns) - min(ts_ns) AS duration_ns,
arg_min(val, ts_ns) AS val FROM r GROUP BY tag_key, run""",
}
