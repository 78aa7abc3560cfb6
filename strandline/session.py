"""Session settings, the shared working folder, and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def build_session(app: str = "strandline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings that the operators assume (UTC, AQE, Arrow). Cluster settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset, a local-mode session gets a temporary folder of its own; on a cluster that would not be
    visible to the executors, so there it is an error.
    """
    where = spark.conf.get(_CHECKPOINT, None)
    if not where:
        where = getattr(spark, "_strandline_dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        where = f"file://{made}"
        spark._strandline_dir = where
    return where.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost
    executors, and lets several consumers share one computation. The table lives until ``release`` or the end of the program."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Delete all tables that ``materialize`` has written; results that are still to be read from them can't be any more."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder stays
            continue


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="strandline-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    archive = os.path.join(made, "strandline.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._strandline_shipped = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, as a Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` has a column of that name."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row. Inputs of more files or
    splits than that, as all large ones are, stay as they are: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions of an explicit exchange: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
