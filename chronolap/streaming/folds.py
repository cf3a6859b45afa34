"""Pure folds over ordered readings; batch and streaming runs share them.

Each takes its state and one reading and returns what it emits; none looks at a wall clock.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass
class ClockGate:
    """Accept a reading that a clock could show after the last one: no earlier and no further on than time has passed.

    `slack` ms either way. A clock may stand. `need` refused readings that could follow one another are the
    new anchor if the clock has moved on among them; one that stands never is.
    """

    slack: int = 1000
    need: int = 3
    last: tuple[int, int] | None = None
    refused: list[tuple[int, int]] = field(default_factory=list)

    def _after(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        return -self.slack <= b[1] - a[1] <= max(b[0] - a[0], 0) + self.slack

    def observe(self, t: int, v: int | None) -> int | None:
        if v is None:
            return None
        now = (t, v)
        if self.last is not None and not self._after(self.last, now):
            self.refused = [*self.refused, now] if self.refused and self._after(self.refused[-1], now) else [now]
            if len(self.refused) < self.need or v <= self.refused[0][1]:
                if len(self.refused) > self.need:  # the first and the last are all that matter
                    del self.refused[1:-self.need + 1]
                return None
        self.last, self.refused = now, []
        return v


@dataclass
class Smoother:
    """Upper median of the last `size` readings, each carried forward to now."""

    size: int = 5
    kept: deque = field(default_factory=deque)

    def observe(self, t: int, v: int | None) -> int | None:
        if v is not None:
            self.kept.append((t, v))
            while len(self.kept) > self.size:
                self.kept.popleft()
        ahead = sorted(x + t - at for at, x in self.kept)
        return ahead[len(ahead) // 2] if ahead else None


@dataclass
class IdentityGate:
    """Two convicting verdicts in a row suspend; any clear one restores."""

    need: int = 2
    against: int = 0
    suspended: bool = False

    def observe(self, verdict: str) -> str | None:
        if verdict == "clear":
            self.against = 0
            if self.suspended:
                self.suspended = False
                return "resumed"
        elif verdict == "convicting":
            self.against += 1
            if self.against >= self.need and not self.suspended:
                self.suspended = True
                return "suspended"
        return None


@dataclass
class Confirmed:
    """A value that counts after `first` equal sightings, and replaces another after `later`."""

    first: int = 2
    later: int = 3
    value: int | None = None
    pending: int | None = None
    seen: int = 0

    def observe(self, v: int | None) -> int | None:
        if v is None:  # not a sighting of anything
            return None
        if v == self.value:
            self.pending, self.seen = None, 0
            return None
        self.seen = self.seen + 1 if v == self.pending else 1
        self.pending = v
        if self.seen < (self.first if self.value is None else self.later):
            return None
        self.value, self.pending, self.seen = v, None, 0
        return v
