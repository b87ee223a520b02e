"""Reading one written moment: which UTC instant it denotes, or why it denotes none or two.

Plain Python over distinct strings only; the operator that calls it is tabweave.operators.timestamps.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

INVALID, NONEXISTENT, AMBIGUOUS = "invalid", "nonexistent", "ambiguous"

# Hours east of UTC of the abbreviations that are read.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CET": 1, "CEST": 2}
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
EPOCH_UNITS = {10: 1_000_000, 13: 1_000, 16: 1}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?:(?P<off>[+-]\d{2}(?::?\d{2})?)|(?P<abbr>[A-Za-z]{1,5})))?(?:\s*\[(?P<zone>[^\[\]]*)\])?"
_WHEN = rf"(?:(?:[Tt]|,?\s+){_TIME})?{_ZONE}"
_DAY = r"(?P<d>\d{1,2})(?:st|nd|rd|th)?"
_MONTH = r"(?P<mon>[A-Za-z]{3,9})\.?"
FORMS = tuple(
    re.compile(form, re.ASCII)
    for form in (
        rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_WHEN}",
        rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}){_WHEN}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?)?{_ZONE}",
        rf"(?:(?P<wd>[A-Za-z]{{3,9}}),?\s+)?{_DAY}[\s-]+{_MONTH},?[\s-]+(?P<y>\d{{4}}){_WHEN}",
        rf"(?:(?P<wd>[A-Za-z]{{3,9}}),?\s+)?{_MONTH}\s+{_DAY},?\s+(?P<y>\d{{4}}){_WHEN}",
    )
)


@lru_cache(4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo("UTC" if name.upper() in ("Z", "UTC", "GMT") else name)
    except (ValueError, OSError, KeyError):
        return None


@lru_cache(256)
def _month(name: str) -> int | None:
    low = name.lower()
    return next((i for m, i in MONTHS.items() if m == low or m[:3] == low or (low == "sept" and i == 9)), None)


def _date(y: int, m: int | None, d: int) -> datetime | None:
    try:
        return datetime(y, m, d) if m else None
    except ValueError:
        return None


def canonical(t: datetime) -> str:
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond:06d}Z"


def read_instant(raw: str, zone: str | None = None) -> str:
    """`YYYY-MM-DDTHH:MM:SS.ffffffZ`, or `invalid`, `nonexistent` or `ambiguous`.

    Zone: an offset in the text, else a known abbreviation, else a zone in brackets, else `zone`, else UTC. Numeric dates
    without a leading year are day first unless that is impossible. 10, 13 or 16 bare digits count seconds, milliseconds or
    microseconds since 1970. A date alone is its midnight. Digits beyond microseconds are cut; seconds end at 59; offsets lie
    between -12:00 and +14:00; a weekday must be that of the date; an unknown zone makes the moment invalid.
    """
    text = raw.strip()
    if text.isascii() and text.isdigit() and len(text) in EPOCH_UNITS:
        return canonical(datetime(1970, 1, 1) + timedelta(microseconds=int(text) * EPOCH_UNITS[len(text)]))
    found = next((m for f in FORMS if (m := f.fullmatch(text))), None)
    if not found:
        return INVALID
    g = found.groupdict()
    y = int(g["y"])
    if "a" in g:
        a, b = int(g["a"]), int(g["b"])
        day = _date(y, b, a) or _date(y, a, b)
    elif "mon" in g:
        day = _date(y, _month(g["mon"]), int(g["d"]))
    else:
        day = _date(y, int(g["m"]), int(g["d"]))
    if day is None:
        return INVALID
    if g.get("wd"):
        low, right = g["wd"].lower(), WEEKDAYS[day.weekday()]
        if not (low == right or (len(low) >= 3 and right.startswith(low))):
            return INVALID
    h, mi, s = (int(g[k] or 0) for k in ("h", "mi", "s"))
    if g.get("ap"):
        if not 1 <= h <= 12:
            return INVALID
        h = h % 12 + 12 * (g["ap"] in "Pp")
    if h > 23 or mi > 59 or s > 59:
        return INVALID
    local = day.replace(hour=h, minute=mi, second=s, microsecond=int(((g["f"] or "") + "000000")[:6]))
    try:
        if g["off"]:
            digits = g["off"][1:].replace(":", "").ljust(4, "0")
            minutes = int(digits[:2]) * 60 + int(digits[2:])
            minutes = -minutes if g["off"][0] == "-" else minutes
            if int(digits[2:]) > 59 or not -720 <= minutes <= 840:
                return INVALID
            return canonical(local - timedelta(minutes=minutes))
        if g["abbr"]:
            hours = ABBREVIATIONS.get(g["abbr"].upper())
            return INVALID if hours is None else canonical(local - timedelta(hours=hours))
        named = g["zone"].strip() if g["zone"] is not None else (zone or "").strip() or "UTC"
        z = _zone(named) if named else None
        if z is None:
            return INVALID
        first, second = (local.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
        if first != second:
            return AMBIGUOUS if first > second else NONEXISTENT
        return canonical(local - first)
    except OverflowError:
        return INVALID


def to_micros(outcome: str) -> int | None:
    """Microseconds since 1970 of a canonical outcome; None for a reason."""
    if outcome[:1].isdigit():
        return (datetime.fromisoformat(outcome) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return None
