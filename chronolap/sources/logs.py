"""Observation and board logs: JSON lines, one file of each kind for a broadcast."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolap.streaming import folds

OBSERVATIONS = "unix_ms long, frame long, t_ms long, ocr string, parsed_ms long, phase string, smoothed_ms long, events array<string>, layout string, offset array<int>, ink array<int>, anchor array<int>, static boolean, retry int, reader string, splits array<long>"
BOARDS = "t_ms long, at_ms long, title string, subtitle string, counter string, rows array<struct<name:string,cells:array<string>,y:long>>"
#: Fixed value: a total read longer ago than this is no total.
FRESH_MS = 30_000


def _read(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Lines of all files kind-<vod>.jsonl; lines that are no such record are left out."""
    lines = spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(f"{folder}/{kind}-*.jsonl")
    vod = F.regexp_extract(F.col("_metadata.file_name"), rf"^{kind}-(.+)\.jsonl$", 1)
    return lines.withColumn("vod", vod).where("broken is null and t_ms is not null").drop("broken")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "obs", OBSERVATIONS)


def boards(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "boards", BOARDS)


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """vod, and whether it has an observation log, for each board log of a folder."""
    names = spark.read.format("binaryFile").load(f"{folder}/*.jsonl").select(F.regexp_extract("path", r"/(boards|obs)-([^/]+)\.jsonl$", 1).alias("kind"), F.regexp_extract("path", r"/(boards|obs)-([^/]+)\.jsonl$", 2).alias("vod"))
    return names.groupBy("vod").agg(F.max(F.col("kind") == "boards").alias("b"), F.max(F.col("kind") == "obs").alias("observed")).where("b").select("vod", "observed")


def believed(readings: DataFrame) -> DataFrame:
    """vod, t_ms, total_ms of the readings that the clock could have shown; readings: vod, t_ms, frame, parsed_ms."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gate, out = folds.ClockGate(), []
        for r in pdf.sort_values(["t_ms", "frame"], kind="stable").itertuples():
            if (v := gate.observe(int(r.t_ms), int(r.parsed_ms))) is not None:
                out.append((r.vod, int(r.t_ms), v))
        return pd.DataFrame(out, columns=["vod", "t_ms", "total_ms"])

    return readings.where("parsed_ms is not null").select("vod", "t_ms", "frame", "parsed_ms").groupBy("vod").applyInPandas(run, "vod string, t_ms long, total_ms long")


def passes(board: DataFrame, observed: DataFrame) -> DataFrame:
    """Each board with the total last believed in the FRESH_MS before it, or null."""
    read = believed(observed).select("vod", "t_ms", F.lit(0).alias("kind"), F.struct("t_ms", "total_ms").alias("seen"), F.lit(None).cast(board.select(F.struct(*board.columns).alias("r")).schema["r"].dataType).alias("r"))
    both = read.union(board.select("vod", "t_ms", F.lit(1), F.lit(None).cast("struct<t_ms:long,total_ms:long>"), F.struct(*board.columns)))
    w = Window.partitionBy("vod").orderBy("t_ms", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("last", F.last("seen", ignorenulls=True).over(w)).where("kind = 1")
    return last.select("r.*", F.when(F.col("t_ms") - F.col("last.t_ms") <= FRESH_MS, F.col("last.total_ms")).alias("total_ms"))


def write_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what is there; nulls are written, so a line has all its fields."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
