"""Subjects: sentences, labels, held-out accuracy."""

import random

from strataline.llm.subjects import SHARE, _owned, _threshold, calibrate, clean_labels, document_subjects, fit_terms, own_sentences

LABELS = "doc_id long, subject string, labeller string"
DOCS = "doc_id long, text string, subject string"


def test_own_sentences_leave_excerpts_out():
    text = "# Title 12\r\nThe page cache is fine. It\r\nwent on.\n\n- An item of a list\n- Another one.\n```\n01-04 21:05:01.123  11  12 I Tag: page cache\n```\n" "01-04 21:05:01.123  11  12 I Tag: page cache\n  0000: 65 11 30 0f d0 1b\n> quoted page cache here\n"
    assert own_sentences(text) == [["the", "page", "cache", "is", "fine"], ["it", "went", "on"], ["an", "item", "of", "a", "list"], ["another", "one"]]
    assert own_sentences("") == own_sentences(" \n ") == []


def make(n, seed):
    r = random.Random(seed)
    own = {"power": ["der akku ist leer", "the wakelock stays", "voltkeeper restarts"], "audio": ["die musik knistert", "the ringtone is lost", "mixcore restarts"]}
    docs, labels, truth = [], [], set()
    for i in range(n):
        subjects = r.sample(["power", "audio"], r.choice([0, 1, 1, 1, 2]))
        sentences = ["Nothing to add", "See the lines", "Thanks to all of you"] + [r.choice(own[s]) for s in subjects for _ in range(4)]
        r.shuffle(sentences)
        docs.append((i, ". ".join(sentences) + ".", None))
        truth |= {(i, s) for s in subjects}
        if i < n // 2:
            labels += [(i, r.choice([" Power", "power"]) if s == "power" else "AUDIO ", r.choice(["a", None])) for s in subjects] or [(i, "none", "a")]
    return docs, labels + labels[:5], truth


def test_held_out_accuracy(spark):
    docs, labels, truth = make(300, 4)
    got = {(r.doc_id, r.subject) for r in document_subjects(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    held = lambda x: {p for p in x if p[0] >= 150}
    hit = len(held(got) & held(truth))
    assert hit / len(held(truth)) > 0.97 and hit / len(held(got)) > 0.97


def test_without_labels_fixed_terms_decide(spark):
    docs = [(1, "The page cache grew. The swap area is full. Nothing else came.", "x"), (2, None, "x"), (3, "", "x"), (4, " \r\n", "x"), (5, "x " * 100_000, "x"), (None, "The page cache grew.", "x")]
    got = document_subjects(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).select("doc_id", "subject").collect()
    assert [tuple(r) for r in got] == [(1, "memory")]
    assert document_subjects(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_labels_are_cleaned(spark):
    df = spark.createDataFrame([(1, " Power\t", "a"), (1, "POWER", None), (2, None, "a"), (None, "power", "a"), (3, " ", "b")], LABELS)
    assert [tuple(r) for r in clean_labels(df).collect()] == [(1, "power")]


def test_every_unlabelled_document_is_fitted(spark):
    docs = [(i, "The page cache grew. The swap area is full. Nothing came of it.", "x") for i in range(200)]
    docs += [(1000 + i, "The page cache grew. Zorvex was busy. Nothing came of it.", "x") for i in range(3)]
    docs += [(2000 + i, "Nothing came of it. That was that.", "x") for i in range(100)]
    own = spark.createDataFrame(docs, DOCS).select("doc_id", "text").mapInArrow(_owned, "doc_id long, own string")
    labels = spark.createDataFrame([(i, "memory", "a") for i in range(100)] + [(i, "none", "a") for i in range(2000, 2100)], LABELS)
    terms = fit_terms(own, clean_labels(labels))
    assert terms["zorvex"][0] == "memory" and "nothing" not in terms  # three documents of 103, whatever a draw of them holds


def test_thresholds_stay_at_the_stated_share_unless_labels_speak_against_it():
    clear = [(0.05, 0, 900), (0.2, 1, 2), (0.3, 9, 10), (0.5, 400, 400)]
    assert _threshold(clear, 410) == SHARE
    assert 0.3 < _threshold([(0.05, 0, 900), (0.3, 0, 300), (0.5, 400, 400)], 400) <= 0.375
    assert 0.125 <= _threshold([(0.05, 0, 900), (0.15, 300, 300), (0.5, 400, 400)], 700) <= 0.15


def test_each_subject_has_a_threshold_of_its_own(spark):
    rows = [(i, s, x) for i in range(3000) for s, x in (("power", 0.3 if i % 2 else 0.6), ("audio", 0.15 if i % 2 else 0.6))]
    labels = [(i, s) for i in range(3000) for s in ("power", "audio") if s == "audio" or not i % 2]
    limits = calibrate(spark.createDataFrame(rows, "doc_id long, subject string, share double"), spark.createDataFrame(labels, "doc_id long, subject string"))
    assert limits["power"] > 0.3 and limits["audio"] <= 0.15


def test_labels_that_give_no_term(spark):
    docs = [(1, "The page cache grew. The swap area is full. Nothing else came.", "x"), (2, "Only this. And that.", "x")]
    labels = spark.createDataFrame([(i, "none", "a") for i in range(9)] + [(2, "power", "a")], LABELS)
    got = document_subjects(spark.createDataFrame(docs, DOCS), labels).select("doc_id", "subject").collect()
    assert [tuple(r) for r in got] == [(1, "memory")]
