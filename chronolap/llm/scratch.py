"""Written intermediate tables in the folder that the cluster shares.

A written table cuts lineage: a lost executor costs only the running stage, and a later reader never
recomputes Python work. The folder is spark.checkpoint.dir; where unset (a local master, as in tests) a
local one is set. The shuffle files of a write are removed as soon as it ends, as nothing reads them again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        conf = "file://" + tempfile.mkdtemp(prefix="chronolap")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet and read again."""
    spark = df.sparkSession
    to = path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(to)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(to)
    out._scratch = to
    return out


def drop(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if to := getattr(t, "_scratch", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(to)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
