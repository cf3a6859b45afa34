"""A store of runs, splits, sessions, transitions and settings in Parquet.

Each table is a folder of versions. A write makes the next version in a staging folder and renames it, so
readers see whole versions only; one writer at a time. Columns that a version lacks are read as null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "runs": "id long, game string, category string, attempt_number long, started_at_ms long, ended_at_ms long, outcome string, reset_reason string, final_time_ms long, last_timer_ms long, session_id long, ls_attempt long",
    "splits": "run_id long, act_index long, act_name string, cumulative_ms long, segment_ms long",
    "sessions": "id long, started_at_ms long, ended_at_ms long, source string, label string, tag string, frames long, parsed long, probing long, relocks long, counter_reads long, events string, vod_id string, vod_created_at_ms long",
    "transitions": "id long, at_ms long, from_phase string, to_phase string, game string, category string, detail string",
    "settings": "key string, value string",
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for name, schema in TABLES.items():
            if not self._versions(name):
                self._commit(name, spark.createDataFrame([], schema))

    def _versions(self, name: str) -> list[int]:
        at = self._fs_path(f"{self.path}/{name}")
        return sorted(int(n) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit()) if self._fs.exists(at) else []

    def _commit(self, name: str, rows: DataFrame) -> None:
        have = self._versions(name)
        staged, to = f"{self.path}/_staging/{name}-{uuid.uuid4().hex}", f"{self.path}/{name}/{(have or [0])[-1] + 1}"
        rows.write.parquet(staged)
        self._fs.mkdirs(self._fs_path(f"{self.path}/{name}"))
        if not self._fs.rename(self._fs_path(staged), self._fs_path(to)):
            raise OSError(f"{to} is there already: another writer was faster")
        for old in have[:-1]:  # the version before stays for those that read it
            self._fs.delete(self._fs_path(f"{self.path}/{name}/{old}"), True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{self._versions(name)[-1]}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows by name; columns they lack are null, others are refused."""
        if odd := set(rows.columns) - set(self.read(name).columns):
            raise ValueError(f"{name} has no columns {sorted(odd)}")
        self._commit(name, self.read(name).unionByName(rows, allowMissingColumns=True))

    def set(self, key: str, value: str) -> None:
        """A setting, new or in place of the old one."""
        new = self.spark.createDataFrame([(key, value)], TABLES["settings"])
        self._commit("settings", self.read("settings").where(F.col("key") != key).union(new))

    def update(self, name: str, changes: DataFrame, key: str = "id") -> None:
        """Values of the changes that are not null replace those of the rows with their key."""
        rows, columns = self.read(name), [c for c in changes.columns if c != key]
        new = changes.withColumnsRenamed({c: f"_{c}" for c in columns})
        self._commit(name, rows.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns)))

    def _latest(self, game: str, category: str) -> Column:
        """Whether a row is the run of the pair that started last (the highest id of a tie)."""
        mine = (F.col("game") == game) & (F.col("category") == category)
        w = Window.partitionBy(mine).orderBy(F.desc("started_at_ms"), F.desc("id"))
        return mine & (F.row_number().over(w) == 1)

    def correct_latest(self, game: str, category: str, final_ms: int) -> None:
        runs = self.read("runs").withColumn("_it", self._latest(game, category))
        fixed = {"outcome": F.lit("finished"), "final_time_ms": F.lit(final_ms).cast("long"), "reset_reason": F.lit(None).cast("string")}
        self._commit("runs", runs.select(*(F.when(F.col("_it"), fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in runs.columns if c != "_it")))

    def void_latest(self, game: str, category: str) -> None:
        """The latest run goes, with its splits."""
        runs = self.read("runs").withColumn("_it", self._latest(game, category))
        gone = runs.where("_it").select(F.col("id").alias("run_id"))
        splits = self.read("splits").join(gone, "run_id", "left_anti").select(*self.read("splits").columns)
        self._commit("splits", splits)
        self._commit("runs", runs.where("not _it").drop("_it"))

    def backup(self, to: str) -> None:
        """The versions of now, copied to a new store."""
        for name in TABLES:
            self.read(name).write.parquet(f"{to.rstrip('/')}/{name}/1")


def union_stores(stores: list[Store], name: str) -> DataFrame:
    """A table of several stores; columns that one lacks are null, src is its place in the list."""
    out = None
    for k, s in enumerate(stores):
        part = s.read(name).withColumn("src", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
