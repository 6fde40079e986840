"""Readings of stated times and the choice among them."""

import itertools
import random
from datetime import datetime, timezone

import numpy as np
import pytest

from strataline.functions import clocks as C
from strataline.functions import layouts as L
from strataline.operators.instants import choose, instants

LINES = "report_id long, line_number long, content string, tz_name string"


def utc(*a, us=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + us


def one(line, tz="Europe/Berlin", boot=None, captured=utc(2025, 1, 4, 12)):
    f = L.extract(L.resolve(L.signature(line)), line)
    at, _ = C.readings(f.clock, f.micros, f.swapped, f.offset, f.abbr, tz, boot, captured)
    return at[0] if at else None


@pytest.mark.parametrize(
    "line,kw,want",
    [
        ("01-04 09:00:00.5 1 2 I T: m", {}, utc(2025, 1, 4, 8, us=500_000)),
        ("01-04 23:00:00.5 1 2 I T: m", {}, utc(2024, 1, 4, 22, us=500_000)),  # this year it would be after the capture
        ("12-31 23:00:00.5 1 2 I T: m", {}, utc(2024, 12, 31, 22, us=500_000)),
        ("02-29 01:00:00.5 1 2 I T: m", {}, utc(2024, 2, 29, 0, us=500_000)),
        ("01-04 09:00:00.5 1 2 I T: m", {"tz": None}, None),
        ("01-04 09:00:00.5 1 2 I T: m", {"tz": "No/Where"}, None),
        ("2024-10-27T02:30:00,000 | INFO | x | m", {}, utc(2024, 10, 27, 0, 30)),  # twice: the earlier
        ("Sun Oct 27 02:30:00 CEST 2024 [x] INFO - m", {}, utc(2024, 10, 27, 0, 30)),
        ("Sun Oct 27 02:30:00 CET 2024 [x] INFO - m", {}, utc(2024, 10, 27, 1, 30)),
        ("Sun Oct 27 02:30:00 +0545 2024 [x] INFO - m", {"tz": None}, utc(2024, 10, 26, 20, 45)),
        ("Sat Jan  4 05:30:00 IST 2025 [x] INFO - m", {"tz": "Asia/Kolkata"}, utc(2025, 1, 4)),
        ("Jan 04, 2025 12:05:00 AM a.B c", {"tz": "UTC"}, utc(2025, 1, 4, 0, 5)),
        ("Jan 04, 2025 12:05:00 PM a.B c", {"tz": "UTC"}, utc(2025, 1, 4, 12, 5)),
        ("[10.5] <7> a: m", {"tz": None, "boot": 1_000_000}, 11_500_000),
        ("[10.5] <7> a: m", {}, None),
        ("2025-01-04 00:00:00.123456789 -0500 1 2 I T: m", {"tz": None}, utc(2025, 1, 4, 5, us=123456)),
    ],
)
def test_single_lines(line, kw, want):
    assert one(line, **kw) == want


def brute(t):
    def cost(path):
        c = C.entry_cost(t)[path[0]]
        for i, (a, b) in enumerate(itertools.pairwise(path)):
            c += C.steps(t[i : i + 2])[0, a, b]
        return c

    return min(cost(p) for p in itertools.product((0, 1), repeat=len(t))), cost


def test_viterbi_is_the_least_path():
    r = random.Random(6)
    for _ in range(60):
        t = np.array([[r.randrange(10**13), r.randrange(10**13)] for _ in range(7)], float)
        for i in range(7):
            k = r.random()
            if k < 0.3:
                t[i, 1] = np.nan
            elif k < 0.4:
                t[i, 0] = np.nan
            elif k < 0.6:
                t[i, 1] = t[i, 0]
        least, cost = brute(t)
        assert cost(C.solve(t)) == pytest.approx(least)


def test_chunks_make_no_difference(spark):
    r = random.Random(7)
    rows = []
    for rid in range(6):
        for n in range(90):
            a, b = r.randrange(10**13), r.randrange(10**13)
            rows.append((rid, n, *r.choice([([a], [-1]), ([a], [0]), ([a, b], [0, 1]), ([a, b], [0, 1]), ([a], [1])])))
    df = spark.createDataFrame(rows + rows[:9], "report_id long, line_number long, readings array<long>, orders array<tinyint>")
    results = [sorted(map(tuple, choose(df, size).collect())) for size in (1000, 7, 16)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 540


def test_evidence_turns_the_order(spark):
    """A source that writes the day first, as its other lines show."""
    lines = [(1, i, f"[{m:02d}.{d:02d}.2024 10:00:0{i},000][INFO ] [x] m", None) for i, (m, d) in enumerate([(1, 20), (2, 3), (2, 25)])]
    reports = spark.sql("select 1L report_id, 'UTC' tz_name, timestamp_ntz'2024-01-01' boot_at, timestamp_ntz'2024-12-31' captured_at")
    got = [r.utc_micros for r in instants(spark.createDataFrame(lines, LINES), reports).orderBy("line_number").collect()]
    assert got == [utc(2024, 1, 20, 10), utc(2024, 2, 3, 10, 0, 1), utc(2024, 2, 25, 10, 0, 2)]


def test_nulls_repeats_and_empty(spark):
    reports = spark.sql("select 1L report_id, 'UTC' tz_name, timestamp_ntz'2024-01-01' boot_at, timestamp_ntz'2024-12-31' captured_at union all select 2L, null, null, null union all select null, 'UTC', null, null")
    line = "[10.5] <7> a: m"
    rows = [(1, 1, line, "x"), (1, 1, line, "y"), (1, 1, None, None), (2, 1, line, None), (3, 1, line, None), (None, 1, line, None), (1, None, line, None), (1, 2, "", None), (1, 3, "x" * 200_000, None)]
    got = instants(spark.createDataFrame(rows, LINES), reports).collect()
    assert [tuple(r) for r in got] == [(1, 1, utc(2024, 1, 1, 0, 0, 10, us=500_000))]
    assert instants(spark.createDataFrame([], LINES), reports).count() == 0
    assert instants(spark.createDataFrame(rows, LINES), reports.limit(0)).count() == 0
