"""Queries that only sum up others, and run times, against plain Python over the smallest tables."""

import os
from collections import Counter

import pytest

from strataline.functions.layouts import LEVELS
from strataline.llm import queries as Q
from strataline.plans.problems import p1_found, p3_found

DATA = os.environ.get("STRATALINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_items_sum_up_the_leaks(spark):
    found = Counter(i for _, i in rows(Q.p7_found(spark, DATA)))
    assert dict(rows(Q.p7_items(spark, DATA))) == dict(found) and found


def test_composition_sums_up_the_subjects(spark):
    assert dict(rows(Q.p8_composition(spark, DATA))) == dict(Counter(s for _, s in rows(Q.p8_found(spark, DATA))))


def test_run_times_are_those_of_the_lines(spark):
    at = {(r, n): t for r, n, t in rows(p1_found(spark, DATA))}
    entries = sorted(rows(p3_found(spark, DATA)))
    runs = rows(Q.p5_runs(spark, DATA))
    assert sorted(r[:4] for r in runs) == sorted(rows(Q.p5_found(spark, DATA))) and runs
    timed = 0
    for report, first, last, n, level, component, start, end, took in runs:
        inside = [e for e in entries if e[0] == report and first <= e[1] and e[2] <= last]
        assert len(inside) == n and {e[3:] for e in inside} == {(level, component)} and level in LEVELS
        times = [at[report, k] for e in inside for k in range(e[1], e[2] + 1) if (report, k) in at]
        assert (start, end) == ((min(times), max(times)) if times else (None, None))
        assert took == (end - start if times else None)
        timed += bool(times)
    assert timed
