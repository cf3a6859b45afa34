"""Every relational query against DuckDB on the same tables, and the folds by hand."""

import glob
import math
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronolap.plans import catalog
from chronolap.streaming import folds

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    b = sorted((tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in order)).fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_overlap_anti_on_odd_rows(spark, duck, tmp_path):
    """Touching bounds, unknown games, lengths and times, spans of days, times before 1970 and copies, as the oracle has them."""
    rnd = random.Random(7)
    edges = [0, 1, 599_999, 600_000, 600_001, 3_000_000, 3_600_000, 7_200_000, -3_600_000, -1, 86_400_000]
    rows = []
    for i in range(1500):
        t = rnd.choice(edges) + rnd.randrange(-20, 100) * 11_000_000 + rnd.choice([0, 0, rnd.randrange(9_000_000)])
        ts = None if i % 50 == 0 else datetime(1970, 1, 1) + timedelta(milliseconds=t)
        length = rnd.choice([None, 0.0, 0.001, 600.0, -300.0, 3600.0, 50_000.0 if i % 30 == 0 else 1.0])
        rows.append((i if i % 70 else None, ts, rnd.choice([None, 1, 2, 8]), rnd.choice(["signup", "error", "error", "purchase", None]), length, '{"k": 1}'))
    pq.write_table(pa.table(dict(zip(["event_id", "ts", "user_id", "event_type", "value", "props"], map(list, zip(*rows))))), tmp_path / "events.parquet")
    sql = catalog.ORACLE["overlap_anti"].replace("FROM events", f"FROM (SELECT * FROM '{tmp_path}/events.parquet' WHERE user_id IS NOT NULL)")
    got, want = catalog.QUERIES["overlap_anti"](spark, str(tmp_path)).collect(), duck.sql(sql).fetchall()
    alone = [(r[0],) for r in rows if r[2] is None and r[3] == "signup"]  # without a user there is no game to share
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want + alone))
    assert 50 < len(want) < sum(r[3] == "signup" for r in rows) - 50


def test_overlap_anti_meets_no_pairs(spark):
    """Rows of a game are not held against each other: what is joined is one row of an hour."""
    plan = catalog.QUERIES["overlap_anti"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and re.findall(r"Join \w+, .*", plan) and all("hour" in j for j in re.findall(r"Join \w+, .*", plan))


def test_folds():
    g = folds.ClockGate()
    assert [g.observe(t, v) for t, v in [(0, 0), (1000, 1000), (2000, 9000), (3000, 10000), (4000, 11000), (5000, 12100)]] == [0, 1000, None, None, 11000, 12100]
    s = folds.Smoother(3)
    assert [s.observe(t, v) for t, v in [(0, 0), (1000, 1000), (2000, 9000), (3000, None)]] == [0, 1000, 2000, 3000]
    i = folds.IdentityGate()
    assert [i.observe(v) for v in ("convicting", "silent", "convicting", "convicting", "clear", "clear")] == [None, None, "suspended", None, "resumed", None]
    c = folds.Confirmed()
    assert [c.observe(v) for v in (5, 5, 6, 6, 6, 5)] == [None, 5, None, None, 6, None]
