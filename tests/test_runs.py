"""The run tracker by hand: one reading a second unless said otherwise."""

import pytest

from chronolap.streaming import folds
from chronolap.streaming.runs import Limits, RunTracker, run_events, run_rows


class Sim:
    def __init__(self, **k):
        self.tracker, self.t = RunTracker(Limits(**k)), 0

    def see(self, *values):
        """The events of all readings."""
        out = []
        for v in values:
            self.t += 1000
            out += self.tracker.observe(self.t, v)
        return out

    def started(self, to):
        assert self.see(0, 1000, 2000, 3000) == [("started", 3000, None, None)]
        assert self.see(*range(4000, to + 1, 1000)) == []
        return self


def reset(v, reason):
    return [("reset", v, None, reason)]


def test_start():
    assert Sim().see(0, 0, 1000, 2000, 3000) == [("started", 3000, None, None)]
    assert Sim().see(*[1_234_500] * 20) == []
    assert Sim().see(5000, 90_000, 12_000, 400_000, 33_000, 700_000) == []
    assert Sim().see(1_500_000, 1_501_000, 1_502_000) == [("started", 1_502_000, None, None)]


def test_finish():
    s = Sim().started(90_000)
    assert s.see(*[90_000] * 4) == [] and s.see(90_000) == [("finished", 90_000, None, None)]
    s = Sim().started(90_000)
    assert s.see(*[90_000, None] * 4) == [] and s.see(90_000) == [("finished", 90_000, None, None)]
    s = Sim().started(30_000)
    assert s.see(*[30_000] * 4, 31_000, *range(32_000, 40_000, 1000)) == [] and s.tracker.run


def test_reset():
    s = Sim().started(5000)
    assert s.see(*[5000] * 4) == [] and s.see(5000) == reset(4000, "tooshort")
    assert Sim().started(45_000).see(0, 0) == reset(45_000, "zeroed")
    assert Sim().started(45_000).see(0, *range(47_000, 56_000, 1000)) == []
    s = Sim(unread_count=6).started(60_000)
    assert s.see(*[None] * 5) == [] and s.see(None) == reset(60_000, "disappeared")
    assert Sim().started(60_000).see(*[None] * 30, 91_000) == []
    # the countdown of the next attempt on a run in its first seconds
    assert Sim().started(4000).see(5000, 4000, 3000) == reset(4000, "zeroed")
    # the offset screen after a long run
    assert Sim().started(45_000).see(5000, 5000, 5000) == reset(45_000, "zeroed")


def test_slips_and_restarts():
    s = Sim().started(60_000)
    assert s.see(300_000, 301_000, 302_000) == [("resynced", 60_000, 302_000, None)]
    assert s.see(152_000, 153_000, 154_000) == [("resynced", 302_000, 154_000, None)]
    s = Sim().started(60_000)
    assert s.see(600, 1600, 2600, 3600) == [*reset(60_000, "desync"), ("started", 3600, None, None)]


def test_misreads():
    s = Sim().started(90_000)
    assert s.see(999_000, *range(92_000, 101_000, 1000), *[100_000] * 4) == [] and s.see(100_000) == [("finished", 100_000, None, None)]
    s = Sim().started(440_000)  # 7:2x read as 1:2x
    assert s.see(*range(81_000, 86_000, 1000), *range(446_000, 450_000, 1000)) == []
    s = Sim().started(38_000)  # a digit in front
    assert s.see(*range(639_000, 650_000, 1000), *range(50_000, 60_000, 1000)) == []


def test_runs_over_a_table(spark):
    rows = [(1, 1000 * i, i, v) for i, v in enumerate([0, 1000, 2000, 3000, *range(4000, 70_001, 1000), *[70_000] * 5, 0, 1000, 2000, 3000, 4000, 0, 0])] + [(2, 0, 999, None)]
    d = spark.createDataFrame(rows, "session_id long, t_ms long, id long, value long")
    e = run_events(d)
    assert [r.event for r in e.orderBy("id").collect()] == ["started", "finished", "started", "reset"]
    got = [tuple(r) for r in run_rows(e, d).orderBy("started_at_ms").collect()]
    assert got == [(1, 0, 75_000, "finished", None, 70_000, None), (1, 76_000, 82_000, "reset", "zeroed", None, 4000)]
    assert run_events(d.limit(0)).count() == 0


def test_gate_lets_a_clock_stand():
    g = folds.ClockGate()
    assert [g.observe(t, 5000) for t in range(0, 20_000, 2000)] == [5000] * 10
    assert [g.observe(t, v) for t, v in ((20_000, 500_000), (22_000, 500_000), (24_000, 500_000), (26_000, 500_000))] == [None] * 4
    assert [g.observe(t, v) for t, v in ((28_000, 502_000), (30_000, 504_000))] == [502_000, 504_000]


def test_unread_passes_do_not_break_a_streak():
    c = folds.Confirmed()
    assert [c.observe(v) for v in (5, None, 5, 6, None, 6, 5, 6, 6, 6)] == [None, None, 5, None, None, None, None, None, None, 6]


@pytest.mark.parametrize("v", [None, 0])
def test_nothing_read(v):
    assert Sim().see(*[v] * 400) == []
