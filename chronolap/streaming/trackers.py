"""Split and attempt-counter folds, built on streaks of like readings, and their runs over tables.

Like the folds beside them they take the time of a reading and never look at a wall clock.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No value yet, in the arrays of SplitTrackers; below every reading.
_NONE = np.iinfo(np.int64).min


@dataclass
class Streak:
    """Like values in a row: each within `slack` of the one held, which is the first or, if `follow`, the newest."""

    slack: int = 0
    follow: bool = False
    value: int | None = None
    count: int = 0

    def see(self, v: int) -> int:
        like = self.count > 0 and abs(v - self.value) <= self.slack
        self.count = self.count + 1 if like else 1
        if self.follow or not like:
            self.value = v
        return self.count

    def clear(self) -> None:
        self.value, self.count = None, 0


class SplitTracker:
    """Cumulative times of acts, told from a comparison column by their change.

    The first value of a row is its baseline. A row that leaves it by more than `slack` for `need` passes is
    done, if its value is positive, at most `ahead` past the clock and above every earlier act. It proves the
    rows before it done as well: those that show a settled value in between are recorded first.
    """

    def __init__(self, rows: int, slack: int = 0, need: int = 2, ahead: int = 2500):
        self.rows, self.slack, self.need, self.ahead = rows, slack, max(1, need), ahead
        self.done: dict[int, int] = {}
        self.rebaseline()

    def rebaseline(self) -> None:
        """The next pass gives new baselines; recorded acts stay."""
        self.base: dict[int, int] = {}
        self.shown = [Streak(self.slack) for _ in range(self.rows)]
        self.changed = [Streak(self.slack, follow=True) for _ in range(self.rows)]

    def _fits(self, row: int, v: int) -> bool:
        return v > 0 and all(x < v for j, x in self.done.items() if j < row)

    def _settled(self, rows: range, end: int) -> list[tuple[int, int]]:
        out = []
        for j in rows:
            s = self.shown[j]
            if j not in self.done and s.count >= self.need and s.value < end and self._fits(j, s.value):
                self.done[j] = s.value
                self.changed[j].clear()
                out.append((j, s.value))
        return out

    def drain(self, end: int) -> list[tuple[int, int]]:
        """At the end of a run: rows whose settled value ties the baseline and fits."""
        return self._settled(range(self.rows), end)

    def observe(self, values: list[int | None], now: int | None) -> list[tuple[int, int]]:
        """(row, cumulative) of the acts that this pass confirms."""
        out = []
        for i, v in enumerate(values[: self.rows]):
            if v is None:
                continue
            self.shown[i].see(v)
            if i in self.done:
                continue
            moved = abs(v - self.base.setdefault(i, v)) > self.slack
            if not (moved and now is not None and v <= now + self.ahead and self._fits(i, v)):
                self.changed[i].clear()
            elif self.changed[i].see(v) >= self.need:
                out += self._settled(range(i), v)
                self.done[i] = v
                out.append((i, v))
        return out


class SplitTrackers:
    """Split trackers of equally many rows side by side: one array row for each act, one column for each tracker.

    Their passes follow the rules of SplitTracker. Only acts that have left their baseline are taken in turn, as
    a confirmed act bears on none but earlier ones and the fit of later ones.
    """

    def __init__(self, rows: int, runs: int, slack: int = 0, need: int = 2, ahead: int = 2500):
        self.slack, self.need, self.ahead = slack, max(1, need), ahead
        self.done, self.base = np.full((2, rows, runs), _NONE)
        self.shown, self.shown_n, self.changed, self.changed_n = np.zeros((4, rows, runs), np.int64)

    def _fits(self, row: int, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (v > 0) & (self.done[:row, k].max(axis=0, initial=_NONE) < v)

    def _settled(self, row: int, k: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        out = []
        for j in np.flatnonzero((self.done[:row, k] == _NONE).any(axis=1)):
            v = self.shown[j, k]
            ok = (self.done[j, k] == _NONE) & (self.shown_n[j, k] >= self.need) & (v < end) & self._fits(j, k, v)
            self.done[j, k[ok]], self.changed_n[j, k[ok]] = v[ok], 0
            out.append((k[ok], int(j), v[ok]))
        return out

    def observe(self, values: np.ndarray, seen: np.ndarray, now: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(trackers, row, cumulatives) of the acts that this pass confirms; values count where `seen`."""
        like = (self.shown_n > 0) & (np.abs(values - self.shown) <= self.slack)
        self.shown_n = np.where(seen, np.where(like, self.shown_n + 1, 1), self.shown_n)
        self.shown = np.where(seen & ~like, values, self.shown)
        left = seen & (self.done == _NONE)
        self.base = np.where(left & (self.base == _NONE), values, self.base)
        moved = left & (np.abs(values - self.base) > self.slack) & (values <= now + self.ahead)
        self.changed_n[left & ~moved] = 0
        out = []
        for i in np.flatnonzero(moved.any(axis=1)):
            k = np.flatnonzero(moved[i])
            fits = self._fits(i, k, values[i, k])
            self.changed_n[i, k[~fits]] = 0
            k = k[fits]
            v, n = values[i, k], self.changed_n[i, k]
            n = np.where((n > 0) & (np.abs(v - self.changed[i, k]) <= self.slack), n + 1, 1)
            self.changed[i, k], self.changed_n[i, k] = v, n
            k, v = k[n >= self.need], v[n >= self.need]
            if len(k):
                out += self._settled(i, k, v)
                self.done[i, k] = v
                out.append((k, int(i), v))
        return out


def _shown_twice(segments: np.ndarray, seen: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    cum = np.where(seen, segments, 0).cumsum(axis=0)
    state = SplitTrackers(*cum.shape, slack=50, need=2)
    out = state.observe(cum + 10_000, seen, np.zeros_like(cum[0]))
    shown = cum + 10_000
    for k, c in enumerate(cum):
        shown[k] = c
        for now in (c + 1000, c + 2000):
            out += state.observe(shown, seen, now)
    return out


def split_passes(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Acts that the split tracker confirms when each is shown twice over a comparison ten seconds slower.

    Rows: run_id, act and segment_ms. Acts are numbered from 0 in each run, in order; one without a time is never
    shown and adds nothing to the others. About `block` rows are held at a time, or the longest run; their runs of
    equally many acts pass through trackers side by side.
    """

    def confirmed(t: pa.Table, upto: int, starts: np.ndarray) -> pa.RecordBatch:
        segments = t["segment_ms"].combine_chunks()
        ms, seen = segments.fill_null(0).to_numpy(), segments.is_valid().to_numpy(zero_copy_only=False)
        lengths, got = np.diff(np.append(starts, upto)), []
        for m in np.unique(lengths):
            first = starts[lengths == m]
            at = first + np.arange(m)[:, None]
            got += [(first[k], np.full(len(k), i), v) for k, i, v in _shown_twice(ms[at], seen[at])]
        first, act, v = (np.concatenate(x) for x in zip((starts[:0], starts[:0], starts[:0]), *got))
        return pa.RecordBatch.from_arrays([t["run_id"].combine_chunks().take(pa.array(first)), pa.array(act), pa.array(v)], ["run_id", "act", "cumulative_ms"])

    def begins(t: pa.Table) -> np.ndarray:
        ids = t["run_id"].combine_chunks()
        v, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (null[1:] != null[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, block
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                t = pa.Table.from_batches(held)
                starts = begins(t)
                last = int(starts[-1])
                if last:
                    yield confirmed(t, last, starts[:-1])
                held, n = t.slice(last).to_batches(), t.num_rows - last
                most = max(block, 2 * n)
        if n:
            t = pa.Table.from_batches(held)
            yield confirmed(t, n, begins(t))

    ordered = rows.select("run_id", "act", "segment_ms").repartition("run_id").sortWithinPartitions("run_id", F.col("act").asc_nulls_last())
    return ordered.mapInArrow(run, "run_id long, act long, cumulative_ms long")


def digit_lost(v: int, p: int, reach: int = 30) -> bool:
    """Whether v is p, or one of the `reach` numbers after it, without one of its digits."""
    short = str(v)
    return any(len(s) == len(short) + 1 and any(s[:k] + s[k + 1 :] == short for k in range(len(s))) for s in map(str, range(p, p + reach + 1)))


@dataclass
class AttemptCounter:
    """Attempt numbers from noisy readings: (change, number, bogus) when a number is adopted, reverted or rebased.

    Higher numbers need two like readings, three before the first adoption of a session, and may grow by
    five and one for every ten seconds. Lower ones count once a run, after two readings; two runs that rise
    there undo the adopted number if they lie above the one before it, or restart below half of it.
    """

    value: int | None = None
    since: int | None = None
    before: int | None = None
    high: Streak = field(default_factory=Streak)
    low: Streak = field(default_factory=Streak)
    runs: deque = field(default_factory=lambda: deque(maxlen=4))
    voted: bool = False
    recent: deque = field(default_factory=lambda: deque(maxlen=8))

    def new_run(self) -> None:
        self.high.clear()
        self.low.clear()
        self.voted = False

    def _adopt(self, t: int, v: int) -> None:
        self.before, self.value, self.since = self.value, v, t
        self.runs.clear()
        self.new_run()

    def observe(self, t: int, v: int | None) -> tuple[str, int, int | None] | None:
        if v is None:
            return None
        self.recent.append(v)
        if self.value is not None and v <= self.value:
            return self._below(t, v) if v < self.value and not digit_lost(v, self.value) else None
        self.low.clear()
        if self.value is not None and self.since is not None and v - self.value > 5 + (t - self.since) // 10_000:
            return None
        if self.value is None and any(w != v and digit_lost(v, w) for w in self.recent):
            return None
        if self.high.see(v) < (3 if self.since is None else 2):
            return None
        self._adopt(t, v)
        return "adopt", v, None

    def _below(self, t: int, v: int) -> tuple[str, int, int | None] | None:
        if self.low.see(v) >= 2 and not self.voted:
            self.voted = True
            self.runs.append(v)
        if len(self.runs) < 2 or not self.runs[-2] < self.runs[-1] < self.value:
            return None
        earlier, latest, was = self.runs[-2], self.runs[-1], self.value
        undo = self.before is not None and earlier > self.before
        if not undo and latest >= was // 2:
            return None
        self._adopt(t, latest)
        return ("revert", latest, was) if undo else ("rebase", latest, None)


def attempt_counter(rows: DataFrame) -> DataFrame:
    """Changes of the counter by session; rows: session_id, t_ms, id, value and started, true where a run begins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = AttemptCounter(), []
        for r in pdf.sort_values(["t_ms", "id"], kind="stable").itertuples():
            if r.started is True or r.started == 1:
                state.new_run()
            if got := state.observe(int(r.t_ms), None if pd.isna(r.value) else int(r.value)):
                out.append((r.session_id, r.id, *got))
        return pd.DataFrame(out, columns=["session_id", "id", "change", "number", "bogus"]).astype({"number": "Int64", "bogus": "Int64"})

    return rows.groupBy("session_id").applyInPandas(run, "session_id long, id long, change string, number long, bogus long")
