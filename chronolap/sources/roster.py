"""Roster files: events of games, checked, as a table."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

from chronolap.functions.names import Name

SCHEMA = "event string, event_position int, position int, game string, goal string, board string, ordered boolean, url string, date string, category string"
#: The keys of an event.
KEYS = {"name", "games", "goals", "board", "ordered", "url", "date", "category"}


def parse(text: str) -> list[tuple]:
    """Rows of SCHEMA; ValueError says what is wrong with a file."""
    raw = tomllib.loads(text)
    if odd := set(raw) - {"event"}:
        raise ValueError(f"unknown keys {sorted(odd)}")
    rows, seen = [], set()
    for k, e in enumerate(raw.get("event", [])):
        if odd := set(e) - KEYS:
            raise ValueError(f"unknown keys {sorted(odd)} of an event")
        games = e.get("games") or []
        if not str(e.get("name", "")).strip() or not games:
            raise ValueError(f"event {k} needs a name and games")
        columns = {}
        for key in ("goals", "board"):
            columns[key] = e.get(key) or [None] * len(games)
            if len(columns[key]) != len(games):
                raise ValueError(f"event {e['name']!r} has {len(games)} games and {len(columns[key])} {key}; they go by position")
        for i, (game, goal, board) in enumerate(zip(games, columns["goals"], columns["board"])):
            folded = "".join(c for c in game.lower() if c.isalnum())
            if not Name.of(game).stem:
                raise ValueError(f"{game!r} of event {e['name']!r} is not a name")
            if folded in seen:
                raise ValueError(f"{game!r} is listed under more than one event")
            seen.add(folded)
            rows.append((e["name"], k, i, game, goal, board, bool(e.get("ordered", False)), e.get("url"), e.get("date"), e.get("category")))
    return rows


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table of a roster file, which Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse(text[0] if text else ""), SCHEMA)
