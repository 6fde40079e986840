"""Exact offset chunking against brute force."""

import random

import pyarrow as pa

from strataline.operators.heavykeys import _number, heavy_keys, key_results, number_hits


def test_results_equal_brute_force(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.7 else r.choice("abcde"), r.randrange(12), r.randrange(300)) for _ in range(6000)]
    df = spark.createDataFrame(rows + [(None, 1, 1), ("a", None, 1), ("a", 1, None)], "key_name string, report_id long, line_number long")
    want = {}
    for k, rep, n in set(rows):
        want.setdefault(k, []).append((rep, n))
    for chunk in (7, 100, 100_000):
        got = {x.key_name: x for x in key_results(df, "t", chunk).collect()}
        assert set(got) == set(want)
        for k, hits in want.items():
            g = got[k]
            assert (g.n_hits, g.n_reports) == (len(hits), len({h[0] for h in hits}))
            assert ((g.first_report, g.first_line), (g.last_report, g.last_line)) == (min(hits), max(hits))
    numbers = sorted((x.key_name, x.report_id, x.line_number, x.hit_no) for x in number_hits(df.dropna()).collect())
    for k, hits in want.items():
        assert [n for key, *_, n in numbers if key == k] == list(range(1, len(hits) + 1))


def test_heavy_keys(spark):
    enhanced = spark.createDataFrame([(" Hot ", 1, i, "x") for i in range(98)] + [("hot", 1, 0, "x"), ("HOT", 1, 0, "x"), ("cold", 1, 1, "x"), ("two", 1, 1, "x"), ("TWO\t", 1, 2, "x"), ("none", 1, None, "x")], "keyword string, report_id long, line_number long, key_name string")
    custom = spark.createDataFrame([("q", 1, [1, 1, None, 3], "k"), ("q", 1, [3], "k"), ("r", 1, [], "k"), ("s", 1, None, "k"), ("t", 2, list(range(40)), "k"), (None, 2, [1], "k")], "query_name string, report_id long, line_numbers array<long>, key_name string")
    assert sorted(map(tuple, heavy_keys(enhanced, custom).collect())) == [("custom_index", "t"), ("enhanced_index", "hot")]
    assert heavy_keys(enhanced.limit(0), custom.limit(0)).count() == 0


def test_numbers_do_not_depend_on_batches():
    r = random.Random(3)
    rows = sorted((r.choice("abc"), r.randrange(3), r.randrange(6)) for _ in range(90))
    want, n = [], {}
    for i, x in enumerate(rows):
        if i == 0 or rows[i - 1] != x:
            n[x[0]] = n.get(x[0], 0) + 1
            want.append((*x, 0, n[x[0]], i > 0 and rows[i - 1][:2] == x[:2]))
    names = ["key_name", "report_id", "line_number", "part"]
    for _ in range(30):
        cuts = sorted(r.randrange(91) for _ in range(r.randrange(12)))
        parts = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, 90])]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in p], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))] + [pa.array([0] * len(p), pa.int32())], names) for p in parts]
        assert [tuple(x.values()) for b in _number(iter(batches)) for x in b.to_pylist()] == want
