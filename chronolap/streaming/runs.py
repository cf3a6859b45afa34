"""The run tracker: starts, finishes, resets and slips of a run from timer readings, one at a time."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Event = tuple[str, int, int | None, str | None]  # kind, value, second value of a slip, reason of a reset


@dataclass(frozen=True)
class Limits:
    """Milliseconds and counts of the rules."""

    start_above: int = 500
    start_count: int = 3
    step: int = 100
    step_slack: int = 2000
    still: int = 150
    still_count: int = 5
    zero: int = 1500
    zero_count: int = 2
    unread_count: int = 180
    jump: int = 5000
    apart_count: int = 3
    restart_below: int = 90_000
    least_final: int = 60_000
    offset: int = 5000
    low: int = 6000
    low_memory: int = 15_000
    cut_count: int = 2
    prefixed_for: int = 180_000


#: Digits that are read for one another.
LOOK_ALIKE = {frozenset(x) for x in ("17", "27", "14", "38", "08", "68", "56", "06", "49", "39")}


def cut_off(expected: int, v: int) -> bool:
    """The expected time without its first digits."""
    return expected > v and any(abs(v - expected % unit) <= 300 for unit in (60_000, 10_000))


def digit_before(expected: int, v: int) -> bool:
    """The expected time with a digit in front: whole tens of minutes too much, or hours from ten minutes on."""
    unit = 600_000 if expected < 600_000 else 3_600_000
    n = (v - expected + unit // 2) // unit
    return v > expected and 1 <= n <= 9 and abs(v - expected - n * unit) <= 1500


def one_glyph_off(expected: int, v: int) -> bool:
    """The expected time, within a second, but for one digit of M:SS that looks like another; not under a minute."""
    if min(expected, v) < 60_000:
        return False
    shown = lambda ms: f"{ms // 60_000}:{ms // 1000 % 60:02d}"
    for e in (expected - 1000, expected, expected + 1000):
        a, b = shown(e), shown(v)
        odd = [frozenset(p) for p in zip(a, b) if p[0] != p[1]]
        if len(a) == len(b) and len(odd) == 1 and odd[0] in LOOK_ALIKE:
            return True
    return False


@dataclass
class Run:
    """A run under way, as of the last reading believed."""

    at: int
    value: int
    still_value: int = 0
    still: int = 0
    zeros: int = 0
    unread: int = 0
    raw: int = 0
    low_at: int = 0
    cuts: int = 0
    held_from: int | None = None  # the value before the timer showed the offset of the next attempt
    odd: deque = field(default_factory=lambda: deque(maxlen=3))

    @classmethod
    def seeded(cls, t: int, v: int) -> Run:
        return cls(t, v, still_value=v, raw=v, low_at=t - v)


class RunTracker:
    """observe(t, reading or None) gives the events of one frame."""

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()
        self.rising: list[tuple[int, int]] = []
        self.run: Run | None = None

    def _follows(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        moved = b[1] - a[1]
        return moved >= self.limits.step and abs(moved - (b[0] - a[0])) <= self.limits.step_slack

    def _end(self, *events: Event) -> list[Event]:
        self.run, self.rising = None, []
        return list(events)

    def _reset(self, value: int, reason: str) -> list[Event]:
        return self._end(("reset", value, None, reason))

    def observe(self, t: int, v: int | None) -> list[Event]:
        return self._waiting(t, v) if self.run is None else self._running(self.run, t, v)

    def _waiting(self, t: int, v: int | None) -> list[Event]:
        if v is None or v <= self.limits.start_above:
            self.rising = []
            return []
        keep = self.rising if not self.rising or self._follows(self.rising[-1], (t, v)) else []
        self.rising = [*keep, (t, v)]
        if len(self.rising) < self.limits.start_count:
            return []
        self.run, self.rising = Run.seeded(t, v), []
        return [("started", v, None, None)]

    def _running(self, r: Run, t: int, v: int | None) -> list[Event]:
        c = self.limits
        if v is None:
            r.unread += 1
            return self._reset(r.value, "disappeared") if r.unread >= c.unread_count else []
        r.unread, before, r.raw = 0, r.raw, v
        expected = r.value + t - r.at
        if v < c.low and not cut_off(expected, v):
            r.low_at = t
        for rule in (self._offset, self._frozen, self._believed, self._zero, self._misread):
            if (out := rule(r, t, v, before, expected)) is not None:
                return out
        return self._apart(r, t, v)

    def _zeros(self, r: Run, value: int) -> list[Event]:
        """Evidence of a reset, which counts when it comes again."""
        r.zeros += 1
        r.odd.clear()
        return self._reset(value, "zeroed") if r.zeros >= self.limits.zero_count else []

    def _died_at(self, r: Run, value: int) -> int:
        shows_offset = abs(value - self.limits.offset) <= self.limits.still
        return r.held_from if shows_offset and r.held_from is not None else value

    def _offset(self, r: Run, t: int, v: int, before: int, expected: int) -> list[Event] | None:
        """The countdown of the next attempt, on a run in its first seconds: held at the offset, told by falling."""
        c = self.limits
        young = r.value < c.offset + 5000
        if young and r.held_from is not None and c.zero < v < c.offset and before <= c.offset + c.still and before - v >= c.still:
            return self._zeros(r, r.held_from)
        if young and r.held_from is None and abs(v - c.offset) <= c.still:
            r.held_from, r.still_value, r.still = r.value, v, 0
            return []
        if v > c.offset + c.still:
            r.held_from = None
        return None

    def _frozen(self, r: Run, t: int, v: int, before: int, expected: int) -> list[Event] | None:
        c = self.limits
        if abs(v - r.still_value) > c.still:
            return None
        r.still, r.zeros = r.still + 1, 0
        r.odd.clear()
        if r.still < c.still_count:
            return []
        if r.still_value < c.least_final:
            return self._reset(self._died_at(r, r.still_value), "tooshort")
        return self._end(("finished", r.still_value, None, None))

    def _believed(self, r: Run, t: int, v: int, before: int, expected: int) -> list[Event] | None:
        if v + self.limits.still < r.value or abs(v - expected) > self.limits.jump:
            return None
        r.at, r.value, r.still_value, r.still, r.zeros, r.cuts = t, v, v, 0, 0, 0
        r.odd.clear()
        return []

    def _zero(self, r: Run, t: int, v: int, before: int, expected: int) -> list[Event] | None:
        c = self.limits
        parked = abs(v - c.offset) <= c.still and abs(v - before) <= c.still and r.value > c.offset + 5000
        return self._zeros(r, self._died_at(r, r.value)) if v < c.zero or parked else None

    def _misread(self, r: Run, t: int, v: int, before: int, expected: int) -> list[Event] | None:
        """Readings set aside, as they say nothing about the run."""
        c = self.limits
        r.zeros = 0
        if one_glyph_off(expected, v) or digit_before(expected, v) and t - r.at < c.prefixed_for:
            return []
        if cut_off(expected, v) and t - r.low_at > c.low_memory and r.cuts < c.cut_count:
            r.cuts += 1
            return []
        return None

    def _apart(self, r: Run, t: int, v: int) -> list[Event]:
        """Rejected readings that agree with one another: the run is another one, or its clock slipped."""
        c = self.limits
        r.odd.append((t, v))
        chain = list(r.odd)
        if len(chain) < c.apart_count or not all(map(self._follows, chain, chain[1:])):
            return []
        self.run = Run.seeded(t, v)
        if v < c.restart_below or 2 * v < r.value:
            return [("reset", r.value, None, "desync"), ("started", v, None, None)]
        return [("resynced", r.value, v, None)]


def run_events(rows: DataFrame) -> DataFrame:
    """Events of each session in order; rows: session_id, t_ms, id, value (null where nothing was read)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = RunTracker(), []
        for r in pdf.sort_values(["t_ms", "id"], kind="stable").itertuples():
            out += [(r.session_id, r.id, k, *e) for k, e in enumerate(state.observe(int(r.t_ms), None if pd.isna(r.value) else int(r.value)))]
        return pd.DataFrame(out, columns=["session_id", "id", "n", "event", "value_ms", "to_ms", "reason"]).astype({"value_ms": "Int64", "to_ms": "Int64"})

    return rows.groupBy("session_id").applyInPandas(run, "session_id long, id long, n int, event string, value_ms long, to_ms long, reason string")


def run_rows(events: DataFrame, readings: DataFrame) -> DataFrame:
    """Runs from events: started_at_ms (the instant less the timer), ended_at_ms, outcome, reason and times; open runs are left out."""
    at = readings.select("session_id", "id", "t_ms")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, began = [], None
        for e in pdf.sort_values(["t_ms", "id", "n"], kind="stable").itertuples():
            if e.event == "started":
                began = int(e.t_ms - e.value_ms)
            elif e.event in ("finished", "reset") and began is not None:
                done = e.event == "finished"
                out.append((e.session_id, began, int(e.t_ms), e.event if done else "reset", e.reason, int(e.value_ms) if done else None, None if done else int(e.value_ms)))
                began = None
        return pd.DataFrame(out, columns=["session_id", "started_at_ms", "ended_at_ms", "outcome", "reset_reason", "final_time_ms", "last_timer_ms"]).astype({"final_time_ms": "Int64", "last_timer_ms": "Int64"})

    schema = "session_id long, started_at_ms long, ended_at_ms long, outcome string, reset_reason string, final_time_ms long, last_timer_ms long"
    return events.join(at, ["session_id", "id"]).groupBy("session_id").applyInPandas(run, schema)
