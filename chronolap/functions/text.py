"""Times and names as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(?:(?:(\d{1,2}):)?(\d{1,3}):)?(\d{1,2})(?:\.(\d{1,3}))?$"


def parse_time(text: Column) -> Column:
    """Milliseconds of H:MM:SS(.f), M:SS(.f) or S.f; null for anything else, bare whole numbers included.

    With hours, minutes are two digits under 60 and hours under 24; without, minutes are under 600.
    Seconds have two digits wherever a colon stands before them, and are under 60.
    """
    s = F.regexp_replace(text, r"\s+", "")
    part = lambda i: F.regexp_extract(s, _SHAPE, i)
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(c.try_cast("bigint"))
    h, m, sec, frac = part(1), part(2), part(3), part(4)
    ok = s.rlike(_SHAPE) & (s.contains(":") | s.contains(".")) & (number(sec) < 60) & ((m == "") | (F.length(sec) == 2))
    ok &= F.when(h != "", (number(m) < 60) & (F.length(m) == 2) & (number(h) < 24)).otherwise(number(m) < 600)
    return F.when(ok, number(h) * 3600000 + number(m) * 60000 + number(sec) * 1000 + number(F.rpad(F.concat(frac, F.lit("000")), 3, "0")))


def format_ms(ms: Column) -> Column:
    """[-]H:MM:SS.t or [-]M:SS.t, tenths cut off."""
    a = F.abs(ms)
    div = lambda n: F.floor(a / n).cast("long")
    low = F.format_string("%02d.%d", div(1000) % 60, div(100) % 10)
    body = F.when(a >= 3600000, F.format_string("%d:%02d:", div(3600000), div(60000) % 60)).otherwise(F.format_string("%d:", div(60000)))
    return F.concat(F.when(ms < 0, "-").otherwise(""), body, low)


def slug(text: Column) -> Column:
    """Lower case; runs of other than letters and digits become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def normalise_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def edit_close(a: Column, b: Column) -> Column:
    """Both non-empty, and at most one edit for every five characters of the longer one."""
    return (a != "") & (b != "") & (F.levenshtein(a, b) * 5 <= F.greatest(F.length(a), F.length(b)))


def _shaped(ok: Column, text: Column) -> Column:
    return F.when(ok, parse_time(text))


def without_stray_digit(text: Column) -> Column:
    """Trimmed; a lone digit before a time with two colons goes."""
    return F.regexp_replace(F.trim(text), r"^\d\s+(?=[^:]*:[^:]*:[^:]*$)", "")


def parse_timer(text: Column) -> Column:
    """parse_time, or with the point put back before two hundredths that a space, nothing after a padded second, or nothing at all separates."""
    t = without_stray_digit(text)
    return F.coalesce(
        parse_time(t),
        _shaped(t.rlike(r"^[\d:]*\d[\d:]* \d\d$"), F.regexp_replace(t, r" (\d\d)$", r".$1")),
        _shaped(t.rlike(r"^[\d:]+:\d{4}$|^\d{3,4}$"), F.regexp_replace(t, r"(\d\d)$", r".$1")),
    )


def parse_total(text: Column) -> Column:
    """A clock's total to the second, a minute at least: separators at the end go, a lone point is a colon, four or five digits have none."""
    t = F.regexp_replace(without_stray_digit(text), r"[.:]+$", "")
    minute = lambda c: F.when(c >= 60000, c)
    digits = F.when(F.length(t) == 4, F.regexp_replace(t, r"^(\d\d)(\d\d)$", r"$1:$2")).otherwise(F.regexp_replace(t, r"^(\d)(\d\d)(\d\d)$", r"$1:$2:$3"))
    return F.coalesce(minute(parse_time(t)), minute(_shaped(t.rlike(r"^[^.]+\..{2}$"), F.regexp_replace(t, r"\.", ":"))), minute(_shaped(t.rlike(r"^\d{4,5}$"), digits)))


def time_shaped(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), r"\.+$", "")
    return t.rlike("[:.]") & parse_time(t).isNotNull()


def has_fraction(text: Column) -> Column:
    return F.trim(text).rlike(r"^[^.]*\.\d")


def parse_counter(text: Column) -> Column:
    """A whole number of up to seven digits, with points and colons around it."""
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"^[.:]+|[.:]+$", "")
    return F.when(s.rlike(r"^\d{1,7}$"), s.cast("bigint"))


def _clock(seconds: Column, tail: Column | None = None) -> Column:
    """[H:M]M:SS of whole seconds, and a tail."""
    s = F.format_string("%02d", seconds % 60)
    m = F.floor(seconds / 60)
    body = F.when(m >= 60, F.format_string("%d:%02d:", F.floor(m / 60), m % 60)).otherwise(F.format_string("%d:", m))
    return F.concat(body, s, *([] if tail is None else [tail]))


def format_seconds(ms: Column) -> Column:
    """Whole seconds, cut off."""
    return _clock(F.floor(ms / 1000))


def format_rounded(ms: Column) -> Column:
    """Whole seconds, rounded half up."""
    return _clock(F.floor((ms + 500) / 1000))


def format_tenths(ms: Column) -> Column:
    """Tenths cut off, a dash for none."""
    return F.when(ms.isNull(), "\u2014").otherwise(_clock(F.floor(ms / 1000), F.format_string(".%d", F.floor(ms / 100) % 10)))


def format_feed(ms: Column) -> Column:
    """Tenths rounded half up, minutes without end, seconds alone under a minute."""
    t = F.floor((ms + 50) / 100)
    m, s = F.floor(t / 600), F.floor(t % 600 / 10)
    return F.when(m > 0, F.format_string("%d:%02d.%d", m, s, t % 10)).otherwise(F.format_string("%d.%d", s, t % 10))


def build_stamp(ms: Column) -> Column:
    """UTC seconds, as 2026-01-02T03:04:05Z (the session's zone is UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(ms / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_day(ms: Column, zone: Column | str = "UTC") -> Column:
    """The calendar day of a zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd")


def event_number(title: Column) -> Column:
    """The number after the first '#'."""
    return F.regexp_extract(title, r"^[^#]*#(\d+)", 1).try_cast("int")


def same_time(a: Column, b: Column) -> Column:
    """Equal, or equal but for an hour that one of them lost."""
    return (a == b) | ((F.least(a, b) < 3600000) & (F.greatest(a, b) % 3600000 == F.least(a, b)))


def game_matches(a: Column, b: Column) -> Column:
    """Equal up to damage: letters and digits only, one inside the other, or edit_close."""
    x, y = (F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")) for c in (a, b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | edit_close(x, y))
