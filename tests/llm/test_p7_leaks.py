"""Leaks against brute force."""

import random

import time
import unicodedata

from strataline.llm import leaks as module
from strataline.llm.leaks import ERRORS, PIECE, RUN, Item, _automaton, holds, leaked, leaks, reach, words


def table(p, t):
    """Plain distances of all beginnings."""
    rows = [list(range(len(t) + 1))]
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a != b)))
        rows.append(row)
    return rows


def test_bit_parallel_reach_is_that_of_plain_distances():
    r = random.Random(2)
    for _ in range(600):
        p = [r.choice("abcdefgh") for _ in range(r.randrange(0, 30))]
        t = list(p)
        for _ in range(r.randrange(6)):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randrange(2)] = [r.choice("abcdefgh")] * r.randrange(2)
        plain = table(p, t)
        at = [[(i, j) for i in range(len(p) + 1) for j in range(len(t) + 1) if plain[i][j] <= e] for e in range(ERRORS + 1)]
        assert reach(p, t) == ([max(i for i, _ in x) for x in at], [max(j for _, j in x) for x in at])


def least(p, t):
    """Least distance of ``p`` to a stretch of ``t``."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def truth(doc, item):
    """Any stretch of 20 or more words of either, of any length."""
    if any(doc[a : a + RUN] == item[b : b + RUN] for b in range(len(item) - RUN + 1) for a in range(len(doc) - RUN + 1)):
        return True
    for x, y in ((item, doc), (doc, item)):
        for n in range(20, len(x) + 1):
            for b in range(len(x) - n + 1):
                w = x[b : b + n]
                # it shares at least nine tenths of its words, else its distance needn't be worked out
                if sum(v in y for v in w) >= 0.9 * n and least(w, y) <= n // 10:
                    return True
    return False


def test_equals_brute_force():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    items = [Item.of(k, [r.choice(vocab) for _ in range(60)]) for k in range(8)]
    auto = _automaton(items)
    seen = set()
    for n in range(100):
        k = r.randrange(8)
        length = r.choice([8, 11, 12, 15, 18, 19, 20, 21, 26, 30, 31, 40, 50])
        at = r.randrange(60 - length + 1)
        part = list(items[k].simple[at : at + length])
        for _ in range(r.choice([0, 1, 2, 2, 3, 3, 4, 5])):
            i, how = r.randrange(len(part)), r.randrange(3)
            part[i : i + (how != 1)] = [] if how == 0 else ["new"]
        doc = [r.choice(vocab) for _ in range(15)] + part + [r.choice(vocab) for _ in range(15)]
        want = [x.id for x in items if truth(doc, x.simple)]
        seen.add((bool(want), length))
        assert leaked(doc, items, auto) == want, (n, length)
    assert {x for x, _ in seen} == {True, False} and PIECE == 6


def test_errors_in_the_middle_of_thirty_words():
    """Every window of 20 has three errors, the 30 words have three."""
    w = [f"w{i}" for i in range(30)]
    doc = list(w)
    doc[11], doc[14], doc[18] = "x", "y", "z"
    items = [Item.of(1, w)]
    assert leaked(doc, items, _automaton(items)) == [1]
    doc[15] = "q"
    assert leaked(doc, items, _automaton(items)) == []


def test_added_words_count_too():
    """Twenty words of the document hold eighteen of the item's and two more."""
    w = [f"w{i}" for i in range(18)]
    items = [Item.of(1, w)]
    assert leaked([*w[:7], "x", *w[7:11], "y", *w[11:]], items, _automaton(items)) == [1]
    assert leaked([*w[:7], "x", *w[7:11], "y", *w[11:14], "z", *w[14:]], items, _automaton(items)) == []


def test_compounds():
    plain = "a nested out-of-memory killer masks the early quota behind one sealed pipeline"
    items = [Item.of(1, words(plain))]
    auto = _automaton(items)
    assert leaked(words(plain.replace("-", " ")), items, auto) == leaked(words(plain), items, auto) == [1]
    long = "t1 t2 t3 t4 t5 t6 t7 t8 t9 out-of-memory u1 u2 u3 u4 u5 u6 v1 w2 w3 w4"
    items = [Item.of(1, words(long))]
    altered = long.replace("out-of-memory", "in-and-out").replace("v1", "v7")  # two of twenty words
    assert leaked(words(altered), items, _automaton(items)) == [1]
    assert leaked(words(altered.replace("t5", "x")), items, _automaton(items)) == []


def test_a_near_miss_of_a_long_item_is_quick():
    r = random.Random(5)
    item = [f"w{r.randrange(10**6)}" for _ in range(800)]
    doc = [w if 0 < i % 8 < 7 else "x" for i, w in enumerate(item)]
    start = time.process_time()
    for q in range(1, 700, 8):
        assert not holds(doc, item, q, q)
    assert (time.process_time() - start) / 88 < 0.02


def test_blocks_and_parts_make_no_difference(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [[r.choice(vocab) for _ in range(n)] for n in (40, 400, 900, 60)]
    items = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(texts)], "item_id long, text string, doc_id string")
    docs = [(k, " ".join(texts[i][a : a + n])) for k, (i, a, n) in enumerate((i, a, n) for i in range(4) for a in range(0, len(texts[i]) - 25, 17) for n in (11, 12, 20))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, leaks(df, items).collect()))
    assert len(want) > 100
    monkeypatch.setattr(module, "PART", 150)
    assert sorted(map(tuple, leaks(df, items, block=300).collect())) == want


def test_disguises():
    plain = "the shallow quota of Wexvel masks an out-of-memory killer beyond 6343 ms"
    for x in (
        "> The *shallow* quota\n> of _Wexvel_ **masks** an `out-of-memory` killer\r\n> beyond 6343 ms",
        "the shallow <b>quota</b> of Wexvel masks an out&#45;of&#45;memory <em>killer</em> beyond 6343 ms",
        'The \\"shallow\\" quota\\nof Wexvel masks an out-of-memory killer beyond\\t6343 ms',
        "THE SHALLOW QUOTA, OF WEXVEL: MASKS AN “OUT‑OF‑MEMORY” KILLER BEYOND 6343 MS!",
        "the sh­allow quota of \\u0057exvel masks an out-of-memory killer beyond 6343 ms",
    ):
        assert words(x) == words(plain)
    accented = "le caf\u00e9 d\u2019\u00e9t\u00e9 na\u00efve \u1e69 \ufb01n"
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert words(unicodedata.normalize(form, accented)) == words(accented) == ["le", "caf\u00e9", "d\u00e9t\u00e9", "na\u00efve", "\u1e69", "fin"]
    assert words("q\u0300uy x\u0301") == ["q\u0300uy", "x\u0301"] and words("state-of-the-art, - x") == ["state-of-the-art", "x"]


def test_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = [(1, "so: " + text[:200], "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", None), (5, text, "x"), (5, text, "x"), (6, "long " * 50_000 + text, "x")]
    items = [(7, "s", text), (7, "s", text), (8, "s", None), (9, "s", ""), (10, "s", "too short")]
    schema = "doc_id long, text string, item_id string"
    got = leaks(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, suite string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 7), (5, 7), (6, 7)]
    few = leaks(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, suite string, text string"), block=1)
    assert sorted(map(tuple, few.collect())) == [(1, 7), (5, 7), (6, 7)]
    none = spark.createDataFrame([], "item_id long, suite string, text string")
    assert leaks(spark.createDataFrame(docs, schema), none).count() == 0


def test_a_passage_whose_pieces_stood_before():
    item = [f"w{i}" for i in range(54)]
    doc = [x for q in range(RUN - PIECE + 1) for x in [*item[q : q + PIECE], *(f"n{q}{k}" for k in range(5))]]
    items = [Item.of(1, item)]
    assert leaked(doc, items, _automaton(items)) == []
    assert leaked(doc + item[:RUN], items, _automaton(items)) == [1]
