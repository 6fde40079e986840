"""Entries with all their lines."""

from strataline.operators.entries import blocks, log_entries
from strataline.operators.parsing import parse_lines, signature_rules

LINES = "report_id long, line_number long, content string, level string"
TEXT = [
    "before anything",
    "------ MIXED ------",
    "01-04 21:05:01.123  11  12 I Tag: one",
    "  more",
    "",
    "Jan 04, 2025 9:00:55 PM a.B$C pump",
    "FINE: two",
    "\tat a.b(C.java:1)",
    "{",
    '  "msg": "three",',
    '  "lvl": "ERR",',
    '  "ts": 1704080828.047,',
    '  "tag": "Warden"',
    "}",
    "Jan 04, 2025 9:00:55 PM a.B pump",  # no level follows: no entry
    "------ 0.5s was the duration of 'MIXED' ------",
    "01-04 21:05:01.123  11  12 F Tag: last",
    "  end",
]
WANT = [(3, 5, "INFO", "Tag"), (6, 8, "DEBUG", "a.B$C"), (9, 14, "ERROR", "Warden"), (17, 18, "FATAL", "Tag")]


def frame(spark, reports=(1,)):
    return spark.createDataFrame([(r, i, x, "extra") for r in reports for i, x in enumerate(TEXT, 1)], LINES)


def test_entries_of_all_layouts(spark):
    got = log_entries(frame(spark, (1, 2))).orderBy("report_id", "first_line").collect()
    assert [tuple(r) for r in got] == [(r, *w) for r in (1, 2) for w in WANT]


def test_chunks_make_no_difference(spark):
    parsed = parse_lines(frame(spark), messages=True).cache()
    whole = sorted(map(str, blocks(parsed, 4096).collect()))
    for size in (1, 2, 5):
        assert sorted(map(str, blocks(parsed, size).collect())) == whole


def test_nulls_repeats_and_empty(spark):
    df = frame(spark)
    odd = spark.createDataFrame([(1, 3, None, None), (1, 4, TEXT[3], "x"), (None, 1, TEXT[2], None), (1, None, TEXT[2], None)], LINES)
    got = log_entries(df.unionByName(odd).unionByName(df)).orderBy("first_line").collect()
    assert [tuple(r)[1:] for r in got] == WANT
    assert log_entries(df.limit(0)).count() == 0


def test_each_signature_is_resolved_once(spark):
    rules = signature_rules(frame(spark, range(5))).collect()
    assert len({bytes(r.signature) for r in rules}) == len(rules)
