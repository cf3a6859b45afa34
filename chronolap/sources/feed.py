"""The feed: a JSON document for each day, a history, a schema, and a manifest that is written last."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolap.functions import text

VERSION, STALE_S = 1, 900
_RUN = ["id", "attempt_number", "ls_attempt", "started_at_ms", "ended_at_ms", "outcome", "reset_reason", "final_time_ms", "last_timer_ms", "session_id"]
_SESSION = ["id", "started_at_ms", "ended_at_ms", "source"]


def published(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Runs with the id they are published under: the start, and 1, 2, ... more for others of that start; a session that is not there is null."""
    k = F.row_number().over(Window.partitionBy("started_at_ms").orderBy("id")) - 1
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("known"))
    r = runs.withColumn("db_id", F.col("id")).withColumn("id", F.col("started_at_ms") + k)
    return r.join(known, "session_id", "left").withColumn("session_id", F.when(F.col("known"), F.col("session_id"))).drop("known")


def days(runs: DataFrame, splits: DataFrame, sessions: DataFrame, today: str, links: bool = False, zone: str = "UTC") -> DataFrame:
    """day, closed, attempts, finished, best_ms and document of each day with a run or a session.

    A document is one value, so a day's runs meet in one task; days are dealt over the cluster.
    """
    day = text.local_day(F.col("started_at_ms"), zone).alias("day")
    cut = splits.groupBy(F.col("run_id").alias("db_id")).agg(F.array_sort(F.collect_list(F.struct("act_index", "act_name", "cumulative_ms"))).alias("splits"))
    r = published(runs, sessions).join(cut, "db_id", "left").withColumn("splits", F.coalesce("splits", F.array().cast("array<struct<act_index:bigint,act_name:string,cumulative_ms:bigint>>")))
    done = F.col("outcome") == "finished"
    by = r.select(day, F.struct(*_RUN, "splits").alias("run"), done.alias("done"), "final_time_ms", "session_id").groupBy("day").agg(
        F.array_sort(F.collect_list("run")).alias("runs"), F.count("*").alias("attempts"), F.count_if("done").alias("finished"), F.min("final_time_ms").alias("best_ms")
    )
    shown = [*_SESSION, *([c for c in ("vod_id", "vod_created_at_ms") if links])]
    of = sessions.select("id", day).union(r.where("session_id is not null").select(F.col("session_id").alias("id"), day)).distinct()
    s = of.join(sessions, "id").groupBy("day").agg(F.array_sort(F.collect_list(F.struct("started_at_ms", F.struct(*shown).alias("s")))).alias("s"), F.count_if(F.col("ended_at_ms").isNull()).alias("open"))
    both = by.join(s, "day", "full_outer").withColumn("closed", (F.col("day") < today) & (F.coalesce("open", F.lit(0)) == 0))
    both = both.withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "finished": F.coalesce("finished", F.lit(0))})
    doc = F.struct("day", "closed", F.struct("attempts", "finished", "best_ms").alias("stats"), F.transform("s", lambda x: x["s"]).alias("sessions"), "runs")
    return both.select("day", "closed", "attempts", "finished", "best_ms", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def json_schema(schema) -> dict:
    """A JSON Schema of a StructType."""
    kind = schema.typeName()
    if kind == "struct":
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in schema.fields}, "required": [f.name for f in schema.fields if not f.nullable]}
    if kind == "array":
        return {"type": "array", "items": json_schema(schema.elementType)}
    return {"type": [{"long": "integer", "integer": "integer", "double": "number", "boolean": "boolean"}.get(kind, "string"), "null"]}


def write(spark: SparkSession, built: DataFrame, to: str, game: str, category: str, today: str, now_ms: int) -> dict:
    """Writes days/<day>.json, history.json, schema.json, then manifest.json; each whole or not at all. Returns the manifest.

    Days come to the driver one partition at a time; days that are not in the frame stay as they are.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(to).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def put(name: str, content: bytes) -> dict:
        part = path(f"{to}/{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(content))
        out.close()
        fs.delete(path(f"{to}/{name}"), False)
        if not fs.rename(part, path(f"{to}/{name}")):
            raise OSError(f"{name} can't be renamed")
        return {"path": name, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}

    entries, history = [], []
    for r in built.orderBy("day").toLocalIterator():
        entries.append({"day": r.day, "closed": r.closed, **put(f"days/{r.day}.json", r.document.encode())})
        if r.attempts:
            history.append({"day": r.day, "attempts": r.attempts, "finished": r.finished, "best_ms": r.best_ms})
    files = {"history": put("history.json", json.dumps({"days": history}).encode()), "schema": put("schema.json", json.dumps(json_schema(built.schema), indent=1).encode())}
    manifest = {"schema_version": VERSION, "generated_at_ms": now_ms, "stale_after_s": STALE_S, "today": today, "game": game, "category": category, "days": entries, "files": files}
    put("manifest.json", json.dumps(manifest, indent=1).encode())
    return manifest


def latest(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: whether a live session is open and since when, the last run, the last finish and the best."""
    at = F.struct("started_at_ms", "id")
    live = (F.col("source") == "hls") & F.col("ended_at_ms").isNull()
    s = sessions.agg(F.coalesce(F.max(live), F.lit(False)).alias("capturing"), F.min_by("started_at_ms", F.when(live, at)).alias("session_started_at_ms"))
    done = F.when(F.col("outcome") == "finished", at)
    shown = F.struct("id", "outcome", "started_at_ms", "final_time_ms", text.format_feed(F.col("final_time_ms")).alias("time"))
    r = runs.agg(F.max_by(shown, at).alias("last"), F.max_by(shown, done).alias("last_finish"), F.min_by(shown, F.when(done.isNotNull(), F.struct("final_time_ms", "id"))).alias("best"), F.count("*").alias("attempts"))
    return s.crossJoin(r)  # one row each
