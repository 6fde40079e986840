"""Signatures, extraction and canonical messages of single lines."""

import random
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest

from strataline.functions import clocks as C
from strataline.functions import layouts as L
from strataline.operators import parsing


def found(line):
    return L.extract(L.resolve(L.signature(line)), line)


#: line, level, component, message
LINES = [
    ("01-04 21:05:01.123  11  12 I Dock Observer: hello: there", "INFO", "Dock Observer", "hello: there"),
    ("02-26 03:43:32.380 15311  15311 15334 D CamBridge   : m", "DEBUG", "CamBridge", "m"),
    ("02-04 06:55:25.925 u58    5458  5468 W vold_lite: m", "WARN", "vold_lite", "m"),
    ("2025-01-04 21:08:53.180 +0530 28845 28879 V BackupHerald: m", "VERBOSE", "BackupHerald", "m"),
    ("D/vold_lite(  871): retry", "DEBUG", "vold_lite", "retry"),
    ("<3>[358081.484851] [6:     kworker/1:3:13924] usb_gadget: m", "ERROR", "usb_gadget", "m"),
    ("kern  :crit  : [25283.023787] emmc_host: m", "FATAL", "emmc_host", "m"),
    ("[562288.384239] [3:     kworker/2:2: 1555] <7> ion_pool: m", "DEBUG", "ion_pool", "m"),
    ("Jan  4 21:12:48 unit-50 lmkeeper[7713]: <notice> m", "INFO", "lmkeeper", "m"),
    ("2025-01-04T21:05:59,196+05:30 | ERR | media.codec | m", "ERROR", "media.codec", "m"),
    ("Sat Jan  4 21:06:15 IST 2025 [keymastr] ALERT - m", "FATAL", "keymastr", "m"),
    ("\x1b[33m[04.01.2025 21:14:36,306][WARNI] [wifi.scan] m\x1b[0m", "WARN", "wifi.scan", "m"),
    ("F0101 00:19:51.635511  28435 route_table.cc:773] m", "FATAL", "route_table.cc", "m"),
    ('{"msg": "m", "lvl": "TRACE", "ts": 1736004649.398, "tag": "t.x"}', "VERBOSE", "t.x", "m"),
    ('level=emerg ts=2025-01-04T15:34:37.094Z msg="a \\"b\\"" component=sensorhubd pid=2', "FATAL", "sensorhubd", 'a \\"b\\"'),
]


@pytest.mark.parametrize("line,level,component,message", LINES)
def test_entries(line, level, component, message):
    for end in ("", "\r"):
        f = found(line + end)
        assert f.kind == L.START
        assert (L.LEVELS[f.level - 1], f.component, f.message) == (level, component, message)


def test_other_kinds():
    assert found("Jan 04, 2025 9:00:55 PM vendor.dock.Charger$Poll pump")[:3] == (L.JUL, 0, "vendor.dock.Charger$Poll")
    assert found("SEVERE: m")[:4] == (L.LEVELLED, 5, None, "m")
    assert found("{").kind == L.JOPEN and found('  "lvl": "ERR",')[:2] == (L.FIELD, 5)
    assert found("------ KERNEL RING ------\t").kind == found("-" * 9 + "x Clients" + "-" * 9).kind == L.STOP
    assert found("----- pid 8128 at 2026-02-04 08:29:17.172533763+0800 -----").kind == L.STAMP


@pytest.mark.parametrize("line", ["", " ", "}", "  quoted: 09-17 11:21:25.933  E HapticHub: older", "    at lab.core.Worker.resolve(Worker.java:807)", "I/O on sector 4", "13-41 99:99:99.1 1 2 I T: m", "x" * 100_000, "\x00\x1f", "é" * 50])
def test_continuations(line):
    assert found(line).kind == L.CONT


@pytest.mark.parametrize(
    "line,clock,micros",
    [
        ("----- pid 1 at 1970-01-02 00:00:00.000001999+0000 -----", L.LOCAL, 86_400_000_001),
        ("--------- 1.2s was the duration of dumpsys x, ending at: 1970-01-01 00:01:00", L.LOCAL, 60_000_000),
        ('  "ts": 1682392531448,', L.EPOCH, 1682392531448000),
        ('  "ts": 1682392531448123,', L.EPOCH, 1682392531448123),
        ('  "ts": 1682392531.4,', L.EPOCH, 1682392531400000),
        ("[12.000345] <7> a: m", L.BOOT, 12_000_345),
    ],
)
def test_times(line, clock, micros):
    f = found(line)
    assert (f.clock, f.micros) == (clock, micros)


def test_both_orders_of_day_and_month():
    f = found("[04.01.2025 00:00:00,000][INFO ] [x] m")
    assert f.swapped > f.micros
    assert found("[14.01.2025 00:00:00,000][INFO ] [x] m").swapped is None
    assert found("[01.14.2025 00:00:00,000][INFO ] [x] m").micros is None


def test_canonical():
    same = ["took 12 ms at 22:15:04 for 0x1F, id=00ab31", "Took  7.5 ms at 02:01:00 for 0xabc, id=fade", "took 1 ms at 1:00:00 for 0x0, id=beef "]
    assert len({L.canonical(x) for x in same}) == 1
    assert L.canonical("rsrp=-27") == L.canonical("rsrp=5") != L.canonical("rsrp=x")
    assert L.canonical(None) == L.canonical(" ") == ""


@pytest.mark.parametrize("a,b", [("service added", "service faded"), ("state=added", "state=faded"), ("a facade", "a decade")])
def test_words_of_the_letters_of_hexadecimal_numbers_are_words(a, b):
    assert L.canonical(a) != L.canonical(b)


# ---------------------------------------------------------------- dirty lines
def parsed(lines):
    """Rows of the Arrow stage that parses, all columns asked for, and the readings of their times."""
    n = len(lines)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n), pa.int64()), pa.array(lines, pa.string())], ["report_id", "line_number", "content"])
    rows = [r for b in parsing._parser(SimpleNamespace(value={}), True, True, True)([batch]) for r in b.to_pylist()]
    for r in rows:
        if r["clock"]:
            for tz in ("Europe/Berlin", None):
                at, orders = C.readings(r["clock"], r["micros"], r["swapped"], r["zone_offset"], r["zone_abbr"], tz, 1_700_000_000_000_000, 1_750_000_000_000_000)
                pa.array([at], pa.list_(pa.int64())), pa.array([orders], pa.list_(pa.int8()))
    return rows


DIRTY = [
    '{"lvl":"I","tag":["a"],"msg":"x"}',
    '{"lvl":"I","tag":true,"msg":"x"}',
    '{"lvl":"I","tag":"t","msg":{"x":1}}',
    '{"lvl":"I","tag":"\\ud800","msg":"\\udc00x"}',
    '{"lvl":["I"],"ts":{},"msg":1}',
    '{"ts":"\u00b2","lvl":"I","msg":"x"}',
    '{"ts":%s,"lvl":"I","msg":"x"}' % ("9" * 25),
    '{"ts":1.%s,"lvl":"I","msg":"x"}' % ("9" * 5000),
    "{" + '"a":{' * 100_000,
    '{"lvl":"I","msg":' + "[" * 100_000 + "]" * 100_000 + "}",
    "[99999999999999999999.000000] <6> tag: msg",
    "<3>[%s.1] a: m" % ("1" * 400),
    "Sat Jan  4 21:06:15 +\u00b2 2025 [x] INFO - m",
    "Sat Jan  4 21:06:15 +123456789 2025 [x] INFO - m",
    "0000-00-00 00:00:00.0 +0000 1 2 I T: m",
    "0001-01-01T00:00:00 | INFO | x | m",
    "9999-12-31T23:59:60.999999999 | INFO | x | m",
    "12-31 23:59:60.999 1 2 I T: m",
    "\x00" * 50,
    "\ufeff" + "01-04 21:05:01.123 11 12 I T: m",
]


@pytest.mark.parametrize("line", DIRTY, ids=range(len(DIRTY)))
def test_no_dirty_line_stops_the_parser(line):
    assert len(parsed([line])) == 1


def test_what_is_not_text_becomes_text():
    rows = parsed(DIRTY[:4])
    assert [r["component"] for r in rows] == ['["a"]', "true", "t", "\ufffd"] and all(r["kind"] == L.START for r in rows)
    assert parsed([DIRTY[10]])[0] | {"message_hash": 0} == {
        "report_id": 1, "line_number": 0, "kind": L.START, "level": 3, "component": "tag", "message_hash": 0, "clock": L.NO_TIME, "micros": None, "swapped": None, "zone_offset": None, "zone_abbr": None,
    }


SEEDS = [x[0] for x in LINES] + ["Jan 04, 2025 9:00:55 PM a.B$C pump", "SEVERE: m", "{", '  "lvl": "ERR",', '  "ts": 1682392531448,', "----- pid 8128 at 2026-02-04 08:29:17.172533763+0800 -----", "--------- 1.2s was the duration of dumpsys x, ending at: 1970-01-01 00:01:00"]
ODD = ["\u00b2", "\u0663", "\u0130", "\u00df", "\ud7ff", "\U0001f600", "\x1b[31m", "\x85", "\u2028", "\t", '"', "\\", "\\u", "\\ud800", "{", "}", "[", "]", ":", "=", "-", "+", "0", "9" * 30, "null", "true", "[]", "1e999", "NaN", " " * 40]


def test_mutated_lines_of_every_layout_go_through():
    r = random.Random(20)
    lines = []
    for _ in range(20_000):
        s = r.choice(SEEDS)
        for _ in range(r.randrange(1, 5)):
            i, j = sorted((r.randrange(len(s) + 1), r.randrange(len(s) + 1)))
            s = r.choice((s[:i] + r.choice(ODD) + s[i:], s[:i] + s[j:], s[:i] + s[i:j] * 2 + s[j:], s[:i] + r.choice(SEEDS)[:j], s[:i] + r.choice(ODD) + s[i + 1 :]))
        lines.append(s)
    assert len(parsed(lines)) == len(lines)


@pytest.mark.parametrize("seed", SEEDS, ids=range(len(SEEDS)))
def test_time_grows_with_the_length_of_a_line(seed):
    lines = []
    for fill in (" ", "x", "9", "f", "a=", "\x1b[", '"', "\\", ": ", ", "):
        long = fill * (100_000 // len(fill))
        lines += [seed + long, seed + long + "!", seed[: len(seed) // 2] + long + seed[len(seed) // 2 :], seed[:-1] + long + seed[-1:]]
    start = time.process_time()
    parsed(lines)
    assert time.process_time() - start < 10  # 4 MB of text


def test_blanks_in_front_hide_no_layout():
    line = '"lvl": "ERR",'
    assert [found(" " * n + line)[:2] for n in (1, 47, 48, 300)] == [(L.FIELD, 5)] * 4


def test_the_head_is_all_a_rule_looks_at(monkeypatch):
    """A signature of the whole line gives no other rule."""
    short = [L.resolve(L.signature(x)) for x in SEEDS]
    monkeypatch.setattr(L, "HEAD", 10_000)
    monkeypatch.setattr(L, "SIGNATURE", 10_000)
    assert [L.resolve(L.signature(x)) for x in SEEDS] == short


def test_signatures_that_are_not_broadcast_make_no_difference(spark, monkeypatch):
    from tests.test_entries import frame

    every = sorted(map(str, parsing.parse_lines(frame(spark), True, True, True).collect()))
    monkeypatch.setattr(parsing, "SIGNATURE_BOUND", 1)
    assert sorted(map(str, parsing.parse_lines(frame(spark), True, True, True).collect())) == every
