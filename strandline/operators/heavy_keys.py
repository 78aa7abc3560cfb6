"""Per-key results where a few keys hold most rows.

A frequent-items sketch (one pass, merged map-side) names every key that can hold more than ``share`` of the rows.
Those keys, at most ``1/share`` and some, are broadcast; their rows are aggregated under a salt and their latest
value fetched through the broadcast join. All other keys take an ordinary shuffle aggregate. The union is exact:
the sketch only decides which way a key takes, never whether it is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from strandline.session import materialize

#: Items tracked by the sketch; its count error is at most 3.5 / TRACKED of the rows.
TRACKED = 8192
SALTS = 64


def heavy_hitters(df: DataFrame, key: str, share: float = 0.01, tracked: int = TRACKED) -> tuple[list, int]:
    """(keys that may hold at least ``share`` of all rows, number of rows). Every key at or above the share is in it.

    Any key of true frequency >= share * N has an estimate >= (share - e) * N with e = 3.5 / tracked, and fewer
    than 1 / (share - e) + 1 keys can reach that, so ``top`` entries hold them all. Null is not a key here.
    """
    eps = 3.5 / tracked
    if share <= 2 * eps:
        raise ValueError(f"share must be above {2 * eps:.4f} for {tracked} tracked items")
    top = int(1 / (share - 2 * eps)) + 2
    row = df.agg(
        F.expr(f"approx_top_k(`{key}`, {top}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    n = row["n"]
    return [x["item"] for x in (row["top"] or []) if x["item"] is not None and x["count"] >= (share - eps) * n], n


def per_key(
    df: DataFrame, key: str, time: str, order: str, value: str | None = None, share: float = 0.01, salts: int = SALTS
) -> DataFrame:
    """One row per non-null ``key``: ``n``, ``first_ts``, ``last_ts`` and ``latest``, the ``value`` of the row that is
    last by (``time``, ``order``), as a string (null without ``value``); ``total`` is the number of all rows, null keys included.

    Null times count in ``n`` but are no first, last or latest; a key with null times only has null there. A null
    value may be the latest. Ties of ``time`` go to the larger ``order``; repeated rows count each. Columns besides
    the named ones are ignored. An empty table gives no rows.
    """
    heavy, total = heavy_hitters(df.select(F.col(key).alias("k")), "k", share)
    value_col = F.col(value).cast("string") if value else F.lit(None).cast("string")
    rows = df.select(
        F.col(key).alias("k"), F.col(time).alias("t"), F.col(order).alias("o"), value_col.alias("v")
    ).where("k is not null")
    spark = df.sparkSession
    last = F.max(F.when(F.col("t").isNotNull(), F.struct("t", "o", "v")))
    light = rows
    parts = []
    if heavy:
        kind = rows.schema["k"].dataType
        names = spark.createDataFrame([(k,) for k in heavy], T.StructType([T.StructField("k", kind)]))
        light = rows.join(F.broadcast(names), "k", "left_anti")
        hot = rows.join(F.broadcast(names), "k")
        # salted, so that the final merge of a key's partials is spread too; numeric buffers keep it a hash aggregate
        # a row per heavy key, written since it is needed twice: as the result, and to fetch the latest values
        counted = materialize(
            hot.groupBy("k", F.pmod(F.xxhash64("o"), F.lit(salts)).alias("salt"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
            .groupBy("k")
            .agg(F.sum("n").alias("n"), F.min("t0").alias("first_ts"), F.max("t1").alias("last_ts")),
            "heavy",
        )
        tips = counted.select("k", F.col("last_ts").alias("t"))
        latest = (
            rows.join(F.broadcast(tips), ["k", "t"])
            .groupBy("k")
            .agg(F.max(F.struct("o", "v")).alias("tip"))
            .select("k", F.col("tip.v").alias("latest"))
        )
        parts.append(counted.join(F.broadcast(latest), "k", "left"))
    parts.append(
        light.groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_ts"), last.alias("tip"))
        .select("k", "n", "first_ts", F.col("tip.t").alias("last_ts"), F.col("tip.v").alias("latest"))
    )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumnRenamed("k", key).withColumn("total", F.lit(total).cast("long"))
