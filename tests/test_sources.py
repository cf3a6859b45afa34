"""Logs, rosters, the store, the feed and streaming runs on small files."""

import hashlib
import json

import pytest

from chronolap.sources import feed, logs, roster, store
from chronolap.streaming import live, runs


def test_logs(spark, tmp_path):
    obs = [{"t_ms": t, "frame": t // 500, "parsed_ms": v} for t, v in ((0, 100_000), (500, 100_500), (1000, 7), (60_000, 160_000))]
    (tmp_path / "obs-v1.jsonl").write_text("\n".join(map(json.dumps, obs)) + "\nnot json\n")
    board = [{"t_ms": t, "title": "T", "rows": [{"name": "a", "cells": ["1:00"]}]} for t in (-5, 500, 1200, 31_000, 60_000)]
    (tmp_path / "boards-v1.jsonl").write_text("\n".join(map(json.dumps, board)) + "\n{broken\n")
    (tmp_path / "boards-v2.jsonl").write_text(json.dumps({"t_ms": 5, "rows": []}))
    got = {(r.vod, r.t_ms): r.total_ms for r in logs.passes(logs.boards(spark, str(tmp_path)), logs.observations(spark, str(tmp_path))).collect()}
    assert got == {("v1", -5): None, ("v1", 500): 100_500, ("v1", 1200): 100_500, ("v1", 31_000): None, ("v1", 60_000): 160_000, ("v2", 5): None}
    assert {(r.vod, r.observed) for r in logs.captured(spark, str(tmp_path)).collect()} == {("v1", True), ("v2", False)}
    logs.write_log(logs.boards(spark, str(tmp_path)).drop("vod"), str(tmp_path / "out"))
    assert spark.read.schema(logs.BOARDS).json(str(tmp_path / "out")).count() == 6


def test_roster(spark, tmp_path):
    good = '[[event]]\nname = "a"\ngames = ["Jaws", "Zelda II"]\ngoals = ["Any%", "All"]\nordered = true\n[[event]]\nname = "b"\ngames = ["Metroid"]\n'
    (tmp_path / "r.toml").write_text(good)
    assert [(r.event, r.position, r.game, r.goal, r.ordered) for r in roster.load(spark, str(tmp_path / "r.toml")).orderBy("event", "position").collect()] == [("a", 0, "Jaws", "Any%", True), ("a", 1, "Zelda II", "All", True), ("b", 0, "Metroid", None, False)]
    for bad in (good + '[[event]]\nname = "c"\ngames = ["jaws"]', '[[event]]\nname = "a"\ngames = []', '[[event]]\nname = ""\ngames = ["Jaws"]', '[[event]]\nname = "a"\ngames = ["Jaws"]\ngoals = ["x", "y"]', '[[event]]\nname = "a"\ngames = ["II"]', "odd = 1"):
        with pytest.raises(ValueError):
            roster.parse(bad)


def _run(i, start, outcome, final=None, session=1):
    return (i, "g", "c", i, start, start + 60_000, outcome, None, final, 5_000, session, None)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append("runs", spark.createDataFrame([_run(1, 1000, "reset"), _run(2, 3000, "reset"), _run(3, 2000, "reset")], store.TABLES["runs"]))
    s.append("splits", spark.createDataFrame([(2, 0, "a", 5, 5), (3, 0, "a", 6, 6)], store.TABLES["splits"]))
    s.append("sessions", spark.createDataFrame([(1, 500, "hls")], "id long, started_at_ms long, source string"))
    s.set("k", "1")
    s.set("k", "2")
    s.correct_latest("g", "c", 777)
    assert {r.id: (r.outcome, r.final_time_ms) for r in s.read("runs").collect()} == {1: ("reset", None), 2: ("finished", 777), 3: ("reset", None)}
    s.update("sessions", spark.createDataFrame([(1, 9000)], "id long, ended_at_ms long"))
    assert s.read("sessions").select("ended_at_ms", "source", "tag").first() == (9000, "hls", None)
    s.void_latest("g", "c")
    assert {r.id for r in s.read("runs").collect()} == {1, 3} and [r.run_id for r in s.read("splits").collect()] == [3]
    assert [r.value for r in s.read("settings").collect()] == ["2"]
    s.backup(str(tmp_path / "copy"))
    other = store.Store(spark, str(tmp_path / "copy"))
    assert store.union_stores([s, other], "runs").count() == 4
    with pytest.raises(ValueError):
        s.append("runs", spark.createDataFrame([(1,)], "odd long"))


def test_feed(spark, tmp_path):
    day = 86_400_000
    r = spark.createDataFrame([_run(1, 1000, "finished", 700_000), _run(2, 1000, "reset"), _run(3, 2 * day, "reset", session=9)], store.TABLES["runs"])
    splits = spark.createDataFrame([(1, 1, "b", 20, 10), (1, 0, "a", 10, 10)], store.TABLES["splits"])
    s = spark.createDataFrame([(1, 500, 9000, "hls"), (2, day, 2 * day, "vod"), (3, 2 * day, None, "hls")], "id long, started_at_ms long, ended_at_ms long, source string")
    built = feed.days(r, splits, s, "1970-01-03")
    m = feed.write(spark, built, str(tmp_path / "feed"), "g", "c", "1970-01-03", 5)
    assert [(d["day"], d["closed"]) for d in m["days"]] == [("1970-01-01", True), ("1970-01-02", True), ("1970-01-03", False)]
    first = json.loads((tmp_path / "feed/days/1970-01-01.json").read_text())
    assert [x["id"] for x in first["runs"]] == [1000, 1001] and [x["act_index"] for x in first["runs"][0]["splits"]] == [0, 1]
    assert json.loads((tmp_path / "feed/days/1970-01-03.json").read_text())["runs"][0]["session_id"] is None
    for d in (*m["days"], *m["files"].values()):
        content = (tmp_path / "feed" / d["path"]).read_bytes()
        assert (len(content), hashlib.sha256(content).hexdigest()) == (d["bytes"], d["sha256"])
    assert m == json.loads((tmp_path / "feed/manifest.json").read_text())
    again = feed.write(spark, feed.days(r.repartition(3), splits, s, "1970-01-03"), str(tmp_path / "feed"), "g", "c", "1970-01-03", 5)
    assert again == m
    x = feed.latest(r, s).first()
    assert (x.capturing, x.session_started_at_ms, x["last"].id, x.last_finish.time, x.best.id) == (True, 2 * day, 3, "11:40.0", 1)


def test_streams_give_what_batches_give(spark, tmp_path):
    values = [0, 1000, 2000, 3000, *range(4000, 70_001, 1000), *[70_000] * 5, 0, 1000, 2000, 3000, 4000, 0, 0]
    rows = [{"session_id": s, "t_ms": 1000 * i, "id": i, "value": v} for s in (1, 2) for i, v in enumerate(values)]
    (tmp_path / "in").mkdir()
    batch = spark.createDataFrame([(r["session_id"], r["t_ms"], r["id"], r["value"]) for r in rows], "session_id long, t_ms long, id long, value long")
    want = sorted((r.session_id, r.id, r.event, r.value_ms) for r in runs.run_events(batch).collect())
    for k, cut in enumerate((range(0, 40), range(40, 1000))):  # a run goes on over two calls
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows if r["id"] in cut))
        live.run(live.read(spark, str(tmp_path / "in")), "runs", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.session_id, r.id, r.kind, r.value_ms) for r in got.collect()) == want
