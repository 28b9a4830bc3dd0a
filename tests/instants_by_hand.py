"""One text at a time, with regular expressions and datetime: what the reading by columns must equal."""

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from stratum.operators.instants import FAMILIES, MONTHS, SCALE, exact_utc, to_micros

PATTERNS = {k: re.compile(v, re.I) for k, v in FAMILIES.items()}
DIGITS = re.compile(r"[0-9]+")
ASCII_ONLY = re.compile(r"[\x00-\x7f−]*")


def zone(name: str | None) -> ZoneInfo | None:
    if not name:
        return ZoneInfo("UTC")
    try:
        return ZoneInfo(name)
    except Exception:  # no such zone
        return None


def _offset(text: str) -> timedelta | None:
    text = re.sub(r"(?i)utc|gmt|\s", "", text).replace("−", "-")
    sign, rest = (-1 if text[0] == "-" else 1), text[1:].replace(":", "")
    if len(rest) == 3:
        rest = f"0{rest}"
    hours, minutes = int(rest[:2]), int(rest[2:] or 0)
    if hours > 15 or minutes > 59:
        return None
    return sign * timedelta(hours=hours, minutes=minutes)


def _read(g: dict, swap: bool, tz: str | None) -> int | None:
    """The instant of a matched notation; swap: the month comes before the day."""
    y, d = int(g["y"]), int(g["d"])
    m = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"])
    if swap:
        d, m = m, d
    micros, carry = 0, 0
    h = mi = s = 0
    if g.get("h"):
        h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
        micros = int(((g.get("f") or "") + "000000")[:6])
        if g.get("ap"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if g["ap"][0] in "pP" else 0)
        elif h == 24 and not (mi or s or micros):
            h, carry = 0, 1
    try:
        wall = datetime(y, m, d, h, mi, s, micros) + timedelta(days=carry)
    except (ValueError, OverflowError):
        return None
    if g.get("off"):
        off = _offset(g["off"])
        return None if off is None else to_micros(wall - off)
    if g.get("utc"):
        return to_micros(wall)
    own = g.get("zb") or g.get("zn")
    at = zone(own or tz)
    return None if at is None else exact_utc(wall, at)


def interpretations(text: str | None, tz: str | None) -> list[tuple[str, int]]:
    """All valid (format, microseconds) readings of one text; none if it isn't a whole, existing date."""
    if text is None:
        return []
    text = text.strip()
    if not text or not ASCII_ONLY.fullmatch(text):
        return []
    if DIGITS.fullmatch(text) and len(text) != 8:
        scale = SCALE.get(len(text))
        return [(f"epoch{len(text)}", int(text) * scale)] if scale else []
    for name, pattern in PATTERNS.items():
        if m := pattern.fullmatch(text):
            g = m.groupdict()
            if name != "slash":
                us = _read(g, False, tz)
                return [] if us is None else [(name, us)]
            both = (("slash_dmy", _read(g, False, tz)), ("slash_mdy", _read(g, True, tz)))
            return [(k, us) for k, us in both if us is not None]
    return []
