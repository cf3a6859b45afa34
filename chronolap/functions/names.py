"""Damaged names resolved to the names of a roster.

A name is reduced to what readings of it have in common (Name); fit() says how well a reading fits a name,
best first: equal, one inside the other, like initials, or a few edits; then whether the number agrees, then
the edits, then whether the board's spelling or the full name was met. Equal fits of two names decide nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A board is an event's with this many of its games, and so many more than the next event has.
HITS, MARGIN = 5, 2
#: Roman numerals as they are read, with l and 1 for i.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
#: Roster rows that are sent to every task at most.
ROSTER_ROWS = 100_000


def _plain(word: str) -> str:
    return "".join(c for c in word if c.isalnum()).lower()


@dataclass(frozen=True)
class Name:
    stem: str
    number: int | None
    initials: str
    single: bool
    torn: bool

    @classmethod
    def of(cls, text: str) -> Name:
        words = [(w, p) for w in text.split() if not w.startswith("(") and (p := _plain(w))]
        parts = [p for _, p in words]
        initials = "".join(p if all(c.isupper() for c in w if c.isalpha()) else p[0] for w, p in words)
        torn = any(len(p) == 1 and p.isalpha() for p in parts[:-1])
        number = None
        if parts:
            last = parts[-1]
            fused = re.fullmatch(r"(.*?[^0-9])([0-9]+)", last)
            if last.isascii() and last.isdigit() and 1 <= int(last) <= 99:
                number, rest = int(last), ""
            elif (roman := re.sub("[l1]", "i", last)) in ROMAN:
                number, rest = ROMAN[roman], ""
            elif fused:
                number, rest = int(fused[2]), fused[1]
            else:
                rest = last
            parts[-1] = rest
        return cls("".join(parts), number, initials, len(words) == 1, torn)


def stretch_distance(a: str, b: str) -> int:
    """Edits from a to the closest stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
    return min(row)


def _in_order(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def like_initials(a: Name, b: Name) -> bool:
    short, long = sorted((a.initials, b.initials), key=len)
    if len(short) < 3:
        return False
    return short == long or ((a.single or b.single) and len(long) - len(short) <= 2 and _in_order(short, long))


def fit(read: Name, name: Name) -> tuple[int, int, int] | None:
    a, b, differs = read.stem, name.stem, int(read.number != name.number)
    shorter, longer = sorted((len(a), len(b)))
    if a == b:
        return 0, differs, 0
    if shorter >= 3 and (a in b or b in a):
        return 1, differs, 0
    if like_initials(read, name):
        return 2, differs, 0
    if 3 * (longer - shorter) > longer:
        return None
    edits = min(stretch_distance(a, b), stretch_distance(b, a))
    return (3, differs, edits) if 5 * edits <= shorter + 5 * read.torn else None


@dataclass(frozen=True)
class Game:
    name: str
    full: Name
    board: Name | None = None

    @classmethod
    def of(cls, name: str, board: str | None = None) -> Game:
        short = Name.of(board) if board else None
        return cls(name, Name.of(name), short if short and short.stem else None)

    def rank(self, read: Name) -> tuple[int, int, int, int] | None:
        found = [(*r, k) for k, n in enumerate((self.board, self.full)) if n and (r := fit(read, n))]
        return min(found, default=None)


def best(read: Name, games: Sequence[Game], strict: bool = False, taken: Iterable[int] = ()) -> tuple[tuple, int] | None:
    """(rank, place) of the one game that fits best; strict: only games whose number is the reading's."""
    if not read.stem:
        return None
    out = set(taken)
    ranked = sorted((r, i) for i, g in enumerate(games) if i not in out and (not strict or read.number in (g.full.number, *([g.board.number] if g.board else []))) and (r := g.rank(read)))
    if not ranked or len(ranked) > 1 and ranked[0][0] == ranked[1][0]:
        return None
    return ranked[0]


def assign(reads: Sequence[str | None], games: Sequence[Game]) -> list[str | None]:
    """A game for each row of one board: the surest pair takes its game, the others are read again without it."""
    names = [Name.of(r or "") for r in reads]
    out: list[str | None] = [None] * len(reads)
    taken: set[int] = set()
    open_ = set(range(len(reads)))
    while open_:
        sure = min(((b[0], row, b[1]) for row in open_ if (b := best(names[row], games, taken=taken))), default=None)
        if sure is None:
            break
        _, row, game = sure
        out[row] = games[game].name
        taken.add(game)
        open_.discard(row)
    return out


def identify(reads: Iterable[str], events: Sequence[Sequence[Game]]) -> int | None:
    """The event whose games a board names: HITS of them and MARGIN more than any other, or one if there is but one event."""
    names = [Name.of(r) for r in reads]
    hits = [len({b[1] for n in names if (b := best(n, games, strict=True))}) for games in events]
    if not hits:
        return None
    top = max(range(len(hits)), key=lambda i: (hits[i], -i))
    others = max((h for i, h in enumerate(hits) if i != top), default=0)
    sure = hits[top] >= 1 if len(hits) == 1 else hits[top] >= HITS and hits[top] >= others + MARGIN
    return top if sure else None


def _games(roster: DataFrame) -> dict:
    rows = roster.select("event", "position", "game", "board").orderBy("event", "position").limit(ROSTER_ROWS + 1).collect()
    if len(rows) > ROSTER_ROWS:
        raise ValueError(f"a roster of more than {ROSTER_ROWS} rows is a table to join, not a roster")
    out: dict = {}
    for r in rows:
        out.setdefault(r.event, []).append(Game.of(r.game, r.board))
    return out


def resolve(names: DataFrame, roster: DataFrame) -> DataFrame:
    """name, game: each distinct name beside the one game of the whole roster that fits it, numbers agreeing."""
    games = [g for x in _games(roster).values() for g in x]

    def run(frames):
        for f in frames:
            found = [best(Name.of(n), games, strict=True) for n in f["name"]]
            yield pd.DataFrame({"name": f["name"], "game": [games[b[1]].name if b else None for b in found]})

    return names.select("name").where("name is not null").distinct().mapInPandas(run, "name string, game string")


def resolve_boards(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """board, position, name, event, game: boards identified by their names, then their rows assigned; rows: board, position, name.

    One board is one group (a board has tens of rows, not a share of the table).
    """
    events = _games(roster)
    keys = list(events)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("position")
        names = [None if pd.isna(n) else n for n in f["name"]]
        at = identify([n for n in names if n], list(events.values()))
        if at is None:
            games = [g for x in events.values() for g in x]
            found = [games[b[1]].name if n and (b := best(Name.of(n), games, strict=True)) else None for n in names]
        else:
            found = assign(names, events[keys[at]])
        return pd.DataFrame({"board": f["board"], "position": f["position"], "name": names, "event": None if at is None else str(keys[at]), "game": found})

    return rows.select("board", F.col("position").cast("long").alias("position"), "name").groupBy("board").applyInPandas(run, "board long, position long, name string, event string, game string")
