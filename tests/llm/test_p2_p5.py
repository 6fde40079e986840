"""Splitting and runs against brute force over a small report set."""

import random

import numpy as np

from strataline.functions import layouts as L
from strataline.llm.runs import collapse, event_runs, spans, symbol_string
from strataline.llm.splitting import PACK, split_sections
from strataline.operators.boundaries import is_marker
from strataline.operators.entries import blocks
from strataline.operators.parsing import parse_lines

LINES = "report_id long, line_number long, content string, keyword string"
SECTIONS = "report_id long, name string, start_line long, end_line long, section_type string, ingested_at string"
QUERIES = "name string, type string, pattern string, enabled boolean, max_tokens_per_file long, overlap_lines int"


def report(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        k = r.random()
        if k < 0.15:
            out.append("")
        elif k < 0.2:
            out.append("------ PART %d ------  " % i)
        elif k < 0.5:
            out.append("  continued " + "x" * r.randrange(120))
        elif k < 0.6:
            out.append("plain " + "y" * r.randrange(500))
        else:
            out.append("01-04 21:05:%02d.123  11  12 I Tag: %s %d" % (r.randrange(60), r.choice(["a", "b"]), r.randrange(3)))
    return out


def brute_pieces(lines, start, end, limit, overlap):
    sums = [0]
    for x in lines:
        sums.append(sums[-1] + (len(x) + 3) // 4)

    def size(a, z):
        return sums[z] - sums[a - 1]

    def natural(i):
        x = lines[i - 1]
        opens = L.extract(L.resolve(L.signature(x)), x).kind in (L.START, L.JUL, L.JOPEN)
        return opens or (bool(x.strip()) and (is_marker(x.strip()) or (i > start and not lines[i - 2].strip())))

    if size(start, end) <= limit:
        return []
    out, at, done = [], start, start - 1
    while True:
        if size(at, end) <= limit:
            return out + [(at, end)]
        while True:
            fits = [e for e in range(done + 1, end) if size(at, e) <= limit]
            if fits or at > done or size(at, end) <= limit:
                break
            at += 1
        if size(at, end) <= limit:
            return out + [(at, end)]
        good = [e for e in fits if natural(e + 1)]
        e = good[-1] if good else fits[-1] if fits else done + 1
        out.append((at, e))
        if e == end:
            return out
        done, at = e, max(start, e + 1 - overlap)


def test_pieces_equal_brute_force(spark):
    texts = {1: report(3 * PACK + 40, 1), 2: report(90, 2), 3: report(PACK, 3)}
    rows = [(r, i, x, None) for r, t in texts.items() for i, x in enumerate(t, 1)]
    rows += rows[:60] + [(r, i, None, "k") for r, i, _, _ in rows[:200]]
    random.Random(5).shuffle(rows)
    sections = [(1, "BIG log", 1, 0, None, "1"), (1, "BIG log", 1, 0, None, "2"), (2, "other Log", 5, 80, "x", "1"), (3, None, 1, 9, "x", "1"), (3, "log tail", 500, 900, "x", "1"), (9, "log of nothing", 1, 0, "x", "1")]
    queries = [("a", "section", "LOG", True, 300, 3), ("b", "Section", "big", True, 90, 0), ("c", "section", "log", False, 10, 0), ("d", "section", "", True, 10, 0), ("e", "section", None, True, 10, 0), ("f", "section", "log", True, None, None), ("g", "keyword", "log", True, 5, 1), ("h", "section", "log", True, 40, 9)]
    got = split_sections(spark.createDataFrame(rows, LINES), spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(queries, QUERIES)).collect()
    want = set()
    for r, name, a, z in [(1, "big log", 1, len(texts[1])), (2, "other log", 5, 80), (3, "log tail", 500, PACK)]:
        for q, pattern, limit, overlap in [("a", "log", 300, 3), ("b", "big", 90, 0), ("f", "log", 32000, 0), ("h", "log", 40, 9)]:
            if pattern in name:
                want |= {(q, r, a, *p) for p in brute_pieces(texts[r], a, z, limit, overlap)}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100


def test_parts_make_no_difference(spark):
    """Sections over many parts, with lines beyond the limit, blank stretches, long overlaps, no natural boundaries."""
    r = random.Random(9)
    texts = {1: report(900, 4), 2: ["", "", ""] * 60 + ["x" * 4000] + ["y" * 40] * 300 + ["z" * 90_000] + ["y" * 37] * 200, 3: [r.choice(["", "a" * r.randrange(60), "b" * 700]) for _ in range(700)], 4: ["q" * 9000] * 30, 5: ["q" * 9000]}
    rows = [(k, i, x, None) for k, t in texts.items() for i, x in enumerate(t, 1)]
    sections = [(k, f"log {k}", a, z, None, "1") for k in texts for a, z in ((1, 0), (40, 600)) if a <= len(texts[k])]
    asked = [("a", 300, 3), ("h", 40, 9), ("i", 64, 500), ("j", 5, 0), ("k", 700, 1)]
    queries = [(q, "section", "log", True, limit, overlap) for q, limit, overlap in asked]
    frames = spark.createDataFrame(rows, LINES).repartition(4), spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(queries, QUERIES)
    want = {(q, k, a, *p) for k, _, a, z, *_ in sections for q, limit, overlap in asked for p in brute_pieces(texts[k], a, min(z or len(texts[k]), len(texts[k])), limit, overlap)}
    for tokens in (1 << 18, 5_600, 6_007):
        got = [tuple(x) for x in split_sections(*frames, part_tokens=tokens).collect()]
        assert len(got) == len(set(got)) and set(got) == want, tokens


def test_lines_between_parts_are_asked_where_they_are(spark):
    """All queries small, so that a report of 3,000 lines has a hundred parts."""
    text = report(3_000, 11)
    sections = spark.createDataFrame([(1, "log", 1, 0, None, "1")], SECTIONS)
    asked = [("a", 60, 4), ("b", 25, 0)]
    queries = spark.createDataFrame([(q, "section", "log", True, limit, overlap) for q, limit, overlap in asked], QUERIES)
    got = split_sections(spark.createDataFrame([(1, i, x, None) for i, x in enumerate(text, 1)], LINES), sections, queries, part_tokens=480)
    assert {tuple(x) for x in got.collect()} == {(q, 1, 1, *p) for q, limit, overlap in asked for p in brute_pieces(text, 1, len(text), limit, overlap)}


def test_empty_tables_give_no_pieces(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert split_sections(e(LINES), e(SECTIONS), e(QUERIES)).count() == 0


def brute_runs(texts):
    found = []
    for r, lines in texts.items():
        entries, last = [], None
        for i, x in enumerate(lines, 1):
            f = L.extract(L.resolve(L.signature(x)), x)
            if f.kind == L.START:
                last = [i, i, (f.level, f.component, [L.canonical(f.message)])]
                entries.append(last)
            elif f.kind in (L.STOP, L.STAMP):
                last = None
                entries.append(None)
            elif last:
                last[1] = i
                last[2][2].append(L.canonical(x))
        i = 0
        while i < len(entries):
            j = i
            while entries[i] and j + 1 < len(entries) and entries[j + 1] and entries[j + 1][2] == entries[i][2]:
                j += 1
            if j > i:
                found.append((r, entries[i][0], entries[j][1], j - i + 1))
            i = j + 1
    return sorted(found)


def test_runs_equal_brute_force_at_any_chunk_size(spark):
    texts = {r: report(300, r) for r in (1, 2, 3)} | {4: ["01-04 21:05:01.123  11  12 I Tag: same %d" % i for i in range(200)]}
    rows = [(r, i, x, None) for r, t in texts.items() for i, x in enumerate(t, 1)]
    df = spark.createDataFrame(rows + rows[:50], LINES)
    parsed = parse_lines(df, messages=True).cache()
    want = brute_runs(texts)
    for size in (7, 64, 4096):
        got = collapse(blocks(parsed, size), size).select("report_id", "first_line", "last_line", "n_events").collect()
        assert sorted(map(tuple, got)) == want
    assert (4, 1, 200, 200) in want


def test_durations(spark):
    lines = spark.createDataFrame([(1, i, "01-04 21:05:%02d.000  11  12 I Tag: beat %d" % (i, i), None) for i in (1, 2, 3)], LINES)
    reports = spark.sql("select 1L report_id, 'UTC' tz_name, timestamp_ntz'2025-01-01' boot_at, timestamp_ntz'2025-01-05' captured_at")
    row = event_runs(lines, reports).first()
    assert (row.n_events, row.last_micros - row.first_micros) == (3, 2_000_000)


def test_symbols():
    of = lambda *codes: spans(symbol_string(np.array(codes, np.int64)))
    assert of(0, 0, -1, 1, 0) == [(0, 1), (4, 4)] and of(2, 3, 3, 3, -1) == [(0, 0), (1, 3)] and of(5) == [(0, 0)] and of(4, 4) == [(0, 1)] and of(-1, -1) == of() == []
    many = symbol_string(np.arange(60_000))
    assert len(set(many)) == 60_000 and many.encode("utf-8")


def test_no_lines_no_runs(spark):
    assert event_runs(spark.createDataFrame([], LINES)).count() == 0
