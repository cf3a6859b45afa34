"""Golden cases of the time, counter and name functions."""

import pytest
from pyspark.sql import functions as F

from chronolap.functions import names, text
from chronolap.functions.names import Game, Name, assign, best, identify, stretch_distance


def column(spark, f, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


def check(spark, f, cases):
    assert dict(zip(cases, column(spark, f, list(cases)))) == cases


def test_parse_time(spark):
    check(spark, text.parse_time, {"1:23:45.6": 5025600, "1:23:45.67": 5025670, "1:23:45.678": 5025678, "12:34.5": 754500, "1:07": 67000, "0:59.99": 59990, "123:45": 7425000, "42.3": 42300, "42": None, "7.25": 7250, " 1:23:45.6 \n": 5025600, "1 : 07": 67000, "74:24:11": None, "94:24:23.7": None})
    bad = ["", ":", "::", "1:", ":30", "1:60", "1:5", "12:345", "1.2.3", "1:23:45:12", "abc", "1:2a", "12:34.", "12:34.5678", "1234:00", "99", "0:0", "1:60:00", "0:00:61", "600:00"]
    assert column(spark, text.parse_time, bad) == [None] * len(bad)


def test_parse_timer(spark):
    check(spark, text.parse_timer, {"11:35.47": 695470, "7.66": 7660, "476": 4760, "4571": 45710, "45": None, "3:06 12": 186120, "1 86": 1860, "4": None, "95958": None, "4a6": None, "1.2 34": 1234, "": None, "34:3795": 2077950, "2:52:2609": 10346090, "1:0547": 65470, "34:379": None, "34:37955": None, "34:9995": None, "34:6012": None, "1:23:45.67": 5025670, "7 4:24:11": 15851000})


def test_parse_total(spark):
    check(spark, text.parse_total, {"15:08:": 908000, "15:05.": 905000, "3:55:28.": 14128000, "3:55:28.3": 14128300, "15.16": 916000, "1526": 926000, "13108": 5468000, "5.16": 316000, "45.3": None, "234": None, ".": None, "19:1084": None, "7 4:24:11...": 15851000})


def test_shapes_and_counters(spark):
    check(spark, text.parse_counter, {"96008": 96008, " 96034.\n": 96034, "96:034": None, "": None, "12345678": None})
    check(spark, text.time_shaped, {"0:47.3": True, "11:35.1": True, "2.0": True, " 1:03:20 ": True, "12:34.": True, "96326": False, "0:4": False, "241.9": False, "8:38.6:": False, "": False, "Act": False})
    check(spark, text.has_fraction, {"0:47.3": True, "5.00": True, "0:4": False, "11:3": False, "0:47.": False})
    check(spark, text.event_number, {"Arcade #6": 6, "none": None, "a #12b #3": 12, "#": None})


def test_formats(spark):
    d = spark.createDataFrame([(0,), (59990,), (67000,), (3600000,), (5025678,), (59950,), (59949,)], "ms long")
    got = d.select(*(f(F.col("ms")) for f in (text.format_ms, text.format_seconds, text.format_rounded, text.format_tenths, text.format_feed))).collect()
    assert [tuple(r) for r in got] == [
        ("0:00.0", "0:00", "0:00", "0:00.0", "0.0"), ("0:59.9", "0:59", "1:00", "0:59.9", "1:00.0"), ("1:07.0", "1:07", "1:07", "1:07.0", "1:07.0"), ("1:00:00.0", "1:00:00", "1:00:00", "1:00:00.0", "60:00.0"),
        ("1:23:45.6", "1:23:45", "1:23:46", "1:23:45.6", "83:45.7"), ("0:59.9", "0:59", "1:00", "0:59.9", "1:00.0"), ("0:59.9", "0:59", "1:00", "0:59.9", "59.9"),
    ]
    one = spark.range(1).select(text.build_stamp(F.lit(1767323045999)), text.local_day(F.lit(1767323045999), "Pacific/Auckland"), text.same_time(F.lit(748000), F.lit(4348000)), text.same_time(F.lit(748000), F.lit(4349000))).first()
    assert tuple(one) == ("2026-01-02T03:04:05Z", "2026-01-02", True, False)


def test_game_matches(spark):
    d = spark.createDataFrame([("Ninja Gaiden", "ninja-gaiden (USA)", True), ("Ninja Galden", "Ninja Gaiden", True), ("", "x", False), ("Metroid", "Tetris", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in d.select("want", text.game_matches(F.col("a"), F.col("b"))).collect())


def test_names():
    assert Name.of("Zelda Il") == Name("zelda", 2, "zi", False, False)
    assert Name.of("SMB2") == Name("smb", 2, "smb2", True, False)
    assert Name.of("SMB3 (Warpless)").stem == "smb" and Name.of("Ill").stem == ""
    assert stretch_distance("stievania", "castlevania") == 1 and stretch_distance("abc", "") == 3
    assert Name.of("Moon C stal").torn
    games = [Game.of(x) for x in ("Castlevania II", "Astyanax", "Legend of Zelda", "Zelda II", "Kabuki Quantum Fighter", "Moon Crystal", "LOTW", "Super Mario Bros 2")]
    fits = lambda r, **k: games[b[1]].name if (b := best(Name.of(r), games, **k)) else None
    assert [fits(x) for x in ("nax", "Castievania", "Kabuki Q Fighter", "Moon C stal", "Leg of Wizard", "SMB2", "Zelda Il", "Nothing at all here", "Il")] == ["Astyanax", "Castlevania II", "Kabuki Quantum Fighter", "Moon Crystal", "LOTW", "Super Mario Bros 2", "Zelda II", None, None]
    assert fits("Castievania", strict=True) is None and fits("Castievania Il", strict=True) == "Castlevania II"


def test_assign_and_identify():
    games = [Game.of(x) for x in ("Legend of Zelda", "Zelda II", "Astyanax")]
    # level fits decide nothing until one of the games is taken
    assert assign(["Zelda Il", "Zelda", None, "nax"], games) == ["Zelda II", "Legend of Zelda", None, "Astyanax"]
    assert assign(["Astyanax", "Astyanax"], games) == ["Astyanax", None]
    short = [Game.of("Kid Klown in Night Mayor World"), Game.of("Parallel World", "World")]
    assert assign(["World"], short) == ["Parallel World"]
    a, b = ([Game.of(f"{w} quest") for w in ws] for ws in (("amber", "basalt", "cobalt", "dolomite", "ember", "flint"), ("garnet", "amethyst", "hazel")))
    reads = ["amber quest", "basalt quest", "cobalt quest", "dolomite quest", "ember quest"]
    assert identify(reads, [a, b]) == 0 and identify(reads[:4], [a, b]) is None and identify(["hazel quest"], [b]) == 0 and identify(reads, []) is None


def test_boards(spark):
    roster = spark.createDataFrame([("a", i, w, None) for i, w in enumerate(("Amber", "Basalt", "Cobalt", "Dolomite", "Ember", "Flint"))] + [("b", 0, "Garnet", "Gar")], "event string, position int, game string, board string")
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(("Amber", "Basalt", "Coba1t", "Dolomite", "Ember", "Flint", None))] + [(2, 0, "Gar")], "board long, position int, name string")
    got = {(r.board, r.position): (r.event, r.game) for r in names.resolve_boards(rows, roster).collect()}
    assert got[(1, 2)] == ("a", "Cobalt") and got[(1, 6)] == ("a", None) and got[(2, 0)] == (None, "Garnet")
    assert {r.name: r.game for r in names.resolve(rows, roster).collect()}["Gar"] == "Garnet"
    assert names.resolve(rows.limit(0), roster).count() == 0


@pytest.mark.parametrize("word", ["", "()", "1"])
def test_empty_names(word):
    assert best(Name.of(word), [Game.of("Astyanax")]) is None
