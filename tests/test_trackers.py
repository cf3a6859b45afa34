"""The split and counter folds by hand, and both over tables."""

import random

import numpy as np
import pytest

from chronolap.plans import catalog
from chronolap.streaming.trackers import AttemptCounter, SplitTracker, SplitTrackers, attempt_counter, digit_lost, split_passes


def test_split_confirmed_and_earlier_rows_filled():
    s = SplitTracker(3, 50, 2)
    assert s.observe([60_000, 120_000, 180_000], 1_000) == []
    assert s.observe([60_000, 120_000, 180_000], 2_000) == []
    assert s.observe([60_010, 118_000, None], 118_100) == []
    assert s.observe([60_010, 118_040, None], 119_000) == [(0, 60_000), (1, 118_040)]
    assert s.observe([50_000, 118_040, 90_000], 119_500) == []  # below the act before it
    assert s.drain(170_000) == [] and s.done == {0: 60_000, 1: 118_040}


def test_split_limits_and_drain():
    s = SplitTracker(2, 0, 1)
    assert s.observe([10_000, 20_000], None) == []
    assert s.observe([12_501, None], 10_000) == [] and s.observe([12_500, None], None) == []
    assert s.observe([12_500, None], 10_000) == [(0, 12_500)]
    assert s.drain(20_000) == [] and s.drain(20_001) == [(1, 20_000)]
    s.rebaseline()
    assert s.observe([1, 2], 5) == [] and s.done == {0: 12_500, 1: 20_000}


@pytest.mark.parametrize(("slack", "need", "ahead"), [(50, 2, 2500), (0, 1, 0), (20, 3, 100), (50, 0, 2500)])
def test_split_trackers_side_by_side(slack, need, ahead):
    """Trackers side by side confirm what each would alone, in the same order, on noisy and unread rows."""
    rnd, rows, runs = random.Random(slack + need), 6, 300
    alone, together = [SplitTracker(rows, slack, need, ahead) for _ in range(runs)], SplitTrackers(rows, runs, slack, need, ahead)
    base = [sorted(rnd.randrange(-500, 60_000) for _ in range(rows)) for _ in range(runs)]
    found = filled = 0
    for step in range(40):
        passes = [[None if rnd.random() < 0.1 else v + rnd.choice([0, 0, 0, slack, -slack, slack + 1, -slack - 1, -2000, -2000, 30_000]) for v in b] for b in base]
        now = [rnd.choice([-(1 << 40), step * 1500, 40_000, 100_000]) for _ in range(runs)]
        want = [t.observe(p, n) for t, p, n in zip(alone, passes, now)]
        got = [[] for _ in range(runs)]
        table = np.array([[v or 0 for v in p] for p in passes]).T
        for ks, row, vs in together.observe(table, np.array([[v is not None for v in p] for p in passes]).T, np.array(now)):
            for k, v in zip(ks.tolist(), vs.tolist()):
                got[k].append((row, v))
        assert got == want
        found += sum(map(len, want))
        filled += sum(len(w) > 1 for w in want)
    assert found > 300 and (filled > 10 or need > 2)


@pytest.mark.parametrize(("block", "batch"), [(1, 3), (50, 7), (1 << 16, 10_000)])
def test_split_passes_over_a_table(spark, block, batch):
    """As one tracker for each run, whichever batches the rows come in; unknown runs, acts and times have defined results."""
    rnd = random.Random(3)
    runs = {r if r else None: [(a if a < 40 else None, rnd.choice([1000, 5000, 30_000, 40, 0, -700, None])) for a in rnd.sample(range(41), rnd.choice([1, 1, 2, 4, 7, 41 if r % 20 == 0 else 3]))] for r in range(120)}
    want = set()
    for r, acts in runs.items():
        cum, total = [], 0
        for _, v in sorted(acts, key=lambda x: (x[0] is None, x[0])):
            total += v or 0
            cum.append((total, v is not None))
        state = SplitTracker(len(cum), 50, 2)
        state.observe([c + 10_000 if read else None for c, read in cum], 0)
        for k, (c, _) in enumerate(cum):
            shown = [(x if j <= k else x + 10_000) if read else None for j, (x, read) in enumerate(cum)]
            want |= {(r, a, v) for now in (c + 1000, c + 2000) for a, v in state.observe(shown, now)}
    rows = [(r, a, v) for r, acts in runs.items() for a, v in acts]
    rnd.shuffle(rows)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = split_passes(spark.createDataFrame(rows, "run_id long, act long, segment_ms long"), block).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert split_passes(spark.createDataFrame([], "run_id long, act long, segment_ms long")).collect() == []


def test_split_tracker_calls_python_for_batches(spark):
    """Not once for each run, of which a large table has millions."""
    plan = catalog.QUERIES["split_tracker"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_counter():
    assert digit_lost(9641, 96_410) and digit_lost(1, 11) and digit_lost(5, 70) and not digit_lost(5, 500) and not digit_lost(12, 12)
    c = AttemptCounter()
    assert [c.observe(t, 40) for t in (0, 1, 2, 3)] == [None, None, ("adopt", 40, None), None]
    assert [c.observe(10, 46), c.observe(11, 46)] == [None, None]  # more than five ahead
    assert [c.observe(10_002, 46), c.observe(10_003, 46)] == [None, ("adopt", 46, None)]
    for n, want in ((43, None), (44, ("revert", 44, 46))):
        c.new_run()
        assert c.observe(20_000, n) is None and c.observe(20_001, n) == want
    c = AttemptCounter(500)
    for n, want in ((7, None), (8, ("rebase", 8, None))):
        c.new_run()
        assert c.observe(1, n) is None and c.observe(2, n) == want
    assert c.observe(3, None) is None and c.value == 8


def test_counter_over_a_table(spark):
    rows = [(1, t, t, 40 if t < 5 else None, t == 0) for t in range(8)] + [(2, 0, 100, None, None)]
    got = attempt_counter(spark.createDataFrame(rows, "session_id long, t_ms long, id long, value long, started boolean")).collect()
    assert [tuple(r) for r in got] == [(1, 2, "adopt", 40, None)]
    assert attempt_counter(spark.createDataFrame(rows[-1:], "session_id long, t_ms long, id long, value long, started boolean")).count() == 0
