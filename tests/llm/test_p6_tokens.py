"""Token ids against a public implementation of the same vocabulary, and round trips."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")

from strataline.llm.queries import vocabulary  # noqa: E402
from strataline.llm.tokens import PATTERN, Encoder, read_vocabulary, token_ids  # noqa: E402


@pytest.fixture(scope="module")
def both():
    data = read_vocabulary(vocabulary())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return Encoder(data), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    ours, public = both
    r = random.Random(1)
    for _ in range(1500):
        s = "".join(r.choice(r.choice(["ab", "abcdefghij", "thein g", "0123", "é漢字🙂", "=-_", "aaaaaaab", " \n\t"])) for _ in range(r.randrange(1, 60)))
        assert ours.encode(s) == public.encode_ordinary(s)


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_any_text(both, s):
    ours, public = both
    ids = ours.encode(s)
    assert ids == public.encode_ordinary(s)
    assert "".join(ours.text[i] for i in ids).encode("latin-1").decode() == s


def test_long_words_take_linear_time(both):
    ours, public = both
    for s in ("a" * 100_000, "=" * 100_000, "ab" * 50_000, " " * 100_000):
        assert ours.encode(s) == public.encode_ordinary(s)


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "  \n ", None), (1, "Hello world", "x"), (None, "a<|endoftext|>b", "x")]
    got = token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string"), vocabulary()).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[1] == [[15496, 995]] * 2 and by[2] == [[]] and by[3] == [[]] and by[4][0] and 50256 not in by[None][0]
    assert token_ids(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0
