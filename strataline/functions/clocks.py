"""Stated times to UTC: zones, years, the order of day and month."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np

from strataline.functions import layouts as L

EPOCH_DAY = datetime(1970, 1, 1)
QUARTER = 900_000_000  # zones change at full quarters of an hour
#: Microseconds from 1970 to the first and last years (5 and 9892) whose dates have a zone's offset; beyond them nothing is an instant.
FIRST, LAST = -62_000_000_000_000_000, 250_000_000_000_000_000

_zones: dict[str, ZoneInfo | None] = {}
_offsets: dict[tuple, int] = {}


def zone(name: str) -> ZoneInfo | None:
    """None for names that are no zone."""
    if name not in _zones:
        try:
            _zones[name] = ZoneInfo(name)
        except Exception:
            _zones[name] = None
    return _zones[name]


def local_offset(tz: str, naive: int, abbr: str | None = None) -> int | None:
    """Microseconds east of UTC of a local time in a zone.

    A local time that occurs twice is the earlier instant, unless ``abbr`` is the
    abbreviation of the later one.  A time skipped in spring is read with the offset
    before the change.  None where the zone isn't one or the time beyond the years it knows.
    """
    if not FIRST <= naive <= LAST:
        return None
    key = (tz, naive // QUARTER, abbr)
    if key not in _offsets:
        if len(_offsets) > 500_000:
            _offsets.clear()
        z = zone(tz)
        if z is None:
            return None
        at = (EPOCH_DAY + timedelta(microseconds=naive // QUARTER * QUARTER)).replace(tzinfo=z)
        late = at.replace(fold=1)
        pick = late if abbr and at.tzname() != abbr and late.tzname() == abbr else at
        _offsets[key] = int(pick.utcoffset().total_seconds()) * 1_000_000
    return _offsets[key]


def _local(naive: int, tz: str | None, offset: int | None, abbr: str | None) -> int | None:
    if offset is not None:
        return naive - offset * 1_000_000
    if not tz or (east := local_offset(tz, naive, abbr)) is None:
        return None
    return naive - east


_years: dict[tuple, int | None] = {}


def _yearless(naive: int, tz: str | None, offset: int | None, abbr: str | None, captured: int | None) -> int | None:
    """The latest year that isn't after ``captured``."""
    if captured is None or (offset is None and not tz) or not FIRST <= captured <= LAST:
        return None
    in_day = naive % 86_400_000_000
    md = EPOCH_DAY + timedelta(days=naive // 86_400_000_000)
    year = (EPOCH_DAY + timedelta(microseconds=captured)).year + 1
    for y in range(year, year - 10, -1):
        day = L._day(y, md.month, md.day)
        if day is not None and (at := _local(day * 86_400_000_000 + in_day, tz, offset, abbr)) is not None and at <= captured:
            return at
    return None


def readings(clock, micros, swapped, offset, abbr, tz, boot, captured) -> tuple[list[int], list[int]]:
    """All valid interpretations of a stated time, as instants in microseconds and the order each
    takes day and month to be in: 0 as its layout has it, 1 exchanged, -1 where the layout leaves no doubt."""
    if clock == L.EPOCH:
        return [micros], [-1]
    if clock == L.BOOT:
        return ([boot + micros], [-1]) if boot is not None and FIRST <= boot <= LAST else ([], [])
    out, orders = [], []
    for order, naive in ((0, micros), (1, swapped)):
        if naive is None:
            continue
        at = _local(naive, tz, offset, abbr) if clock == L.LOCAL else _yearless(naive, tz, offset, abbr, captured)
        if at is not None and (order == 0 or captured is None or at <= captured):
            out.append(at)
            orders.append(order)
    return out, orders


# ---------------------------------------------------------------- Viterbi
#: Costs: of changing the order of day and month, of beginning with it exchanged, of a jump backward in
#: time by h hours BACK * (1 + log2(1 + h)).
SWITCH, EXCHANGED, BACK, NEVER = 3.0, 4.0, 1.0, 1e12


def steps(t: np.ndarray) -> np.ndarray:
    """Cost of state a at record i and b at record i + 1, as [i, a, b]."""
    hours = (t[:-1, :, None] - t[1:, None, :]) / 3.6e9
    with np.errstate(invalid="ignore"):
        cost = np.where(hours > 0, BACK * (1 + np.log2(1 + np.maximum(hours, 0))), 0.0)
    cost[:, 0, 1] += SWITCH
    cost[:, 1, 0] += SWITCH
    cost[np.isnan(hours)] = NEVER
    return cost


def best(cost: np.ndarray, start: list[float]) -> tuple[list[float], list[list[int]]]:
    """Least cost of ending in each state, and the state before it for each record."""
    c0, c1 = start
    back = []
    for (a, b), (c, d) in cost.tolist():
        x, y, z, w = c0 + a, c1 + c, c0 + b, c1 + d
        back.append((0 if x <= y else 1, 0 if z <= w else 1))
        c0, c1 = x if x <= y else y, z if z <= w else w
    return [c0, c1], back


def trace(back: list, last: int) -> list[int]:
    path = [last]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def entry_cost(t: np.ndarray) -> list[float]:
    """Cost of the first record's states when nothing goes before."""
    return [NEVER if math.isnan(t[0, 0]) else 0.0, NEVER if math.isnan(t[0, 1]) else EXCHANGED]


def matrix(t: np.ndarray) -> list[list[float]]:
    """Least cost from each state of the first record to each of the last, for joining chunks."""
    cost = steps(t)
    return [best(cost, [0.0 if s == 0 else NEVER, 0.0 if s == 1 else NEVER])[0] for s in (0, 1)]


def solve(t: np.ndarray, first: int | None = None, last: int | None = None) -> list[int]:
    """Path of states; ``first`` and ``last`` fix the states at the ends."""
    start = entry_cost(t) if first is None else [0.0 if first == 0 else NEVER, 0.0 if first == 1 else NEVER]
    ends, back = best(steps(t), start)
    return trace(back, (0 if ends[0] <= ends[1] else 1) if last is None else last)
