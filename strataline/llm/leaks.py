"""Held-out test items that leaked into documents (problem 7).

A document holds an item's passage if it has 12 of the item's words in a row, or a stretch of at least 20 words in order
of which at most one in ten is altered, missing or added; the stretch may be counted in words of the item or of the document.

How much must be looked at: of a stretch of 40 words or more with one error in ten, either the first 20 words have at
most two errors and are a passage themselves, or the rest is one with less than its share of errors; so every passage
holds one of 20 to 29 words with at most two errors or of 30 to 39 with three.  By pigeonhole 18 words in three pieces,
or 27 in four, leave one piece of six words or more whole.  So all pieces of six words of the items go into one
automaton, every document is run through it once, and where a piece occurs the passage is verified outward from it on
both sides, over at most 33 words and three errors, with Myers' bit-parallel distance.  The cost of a hit depends
neither on the length of the item nor on that of the document.

A compound with hyphens may be written as several words, and one altered compound is one altered word: pieces are looked for
and verified with compounds split, and an item with compounds that was met but not verified is tried once more with them whole.

Long items are cut to overlapping parts and the parts are taken in blocks of a bounded number of pieces, one pass over the
documents' words for each block.  The documents are never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import materialize

#: Words in a row, words of an altered stretch, one error in so many words.
RUN, STRETCH, PER_ERROR = 12, 20, 10
#: Errors and words of the longest stretch that needs to be verified.
ERRORS, LONGEST = 3, 2 * STRETCH - 1
#: Words of a piece: a stretch with k errors has k + 1 pieces, the longest of at least this many.
PIECE = (STRETCH - STRETCH // PER_ERROR) // (STRETCH // PER_ERROR + 1)
#: Pieces in a broadcast block (about 200 MB of automaton in a worker).
BLOCK = 50_000
#: Words of an item's part, and words it shares with the next, so that no passage is cut.
PART, SHARED = 5_000, LONGEST + 2 * ERRORS + RUN

_escape = re.compile(r"\\u([0-9a-fA-F]{4})|\\[ntrfb]|\\").sub
_tag = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>").sub
_inline = frozenset("a abbr b big code em font i kbd mark s small span strong sub sup tt u".split())
#: Letters and digits, with the combining marks that have no composed form; compounds are one word.
_letter = "[^\\W_][\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]*"
_words = re.compile(f"(?:{_letter})+(?:-(?:{_letter})+)*").findall
#: Apostrophes inside words go, as do characters of no width; a hyphen has one spelling.
_apostrophe = re.compile("(?<=[^\\W_])['\u2019](?=[^\\W_])").sub
_spelling = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff")) | {0x2010: "-", 0x2011: "-"}


def words(text: str) -> list[str]:
    """Words of a text without case, punctuation, markup, quoting, escapes and spacing, in one Unicode form (NFKC).
    Words joined by hyphens are one, with these hyphens."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _escape(lambda m: chr(int(m[1], 16)) if m[1] else " " if len(m[0]) > 1 else "", text)
    if "<" in text:
        text = _tag(lambda m: "" if m[2].lower() in _inline else " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_spelling))
    text = text.lower()
    if "'" in text or "\u2019" in text:
        text = _apostrophe("", text)
    return _words(text)


def simple(compounds: list[str]) -> list[str]:
    """Words with compounds split."""
    return " ".join(compounds).replace("-", " ").split(" ") if compounds else []


def reach(item: list[str], doc: list[str]) -> tuple[list[int], list[int]]:
    """How far ``item`` and ``doc`` agree from their beginnings with at most 0, 1, ... ``ERRORS`` words altered, missing or
    added: the most words of the item, and the most of the document.

    Myers' bit-parallel algorithm with words for letters; the distance of each pair of beginnings of about the same length
    is read off the vertical differences of its columns.
    """
    m = len(item)
    mask = (1 << m) - 1
    peq: dict[str, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    far_item, far_doc = [0] * (ERRORS + 1), [0] * (ERRORS + 1)
    pv, mv = mask, 0
    for j in range(len(doc) + 1):
        if j:
            eq = peq.get(doc[j - 1], 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (~(xh | pv) & mask), pv & xh
            ph, mh = (ph << 1 | 1) & mask, (mh << 1) & mask
            pv, mv = mh | (~(xv | ph) & mask), ph & xv
        least = ERRORS + 1
        for i in range(max(0, j - ERRORS), min(m, j + ERRORS) + 1):
            low = (1 << i) - 1
            d = j + (pv & low).bit_count() - (mv & low).bit_count()
            if d <= ERRORS:
                least = min(least, d)
                far_item[d] = max(far_item[d], i)
                far_doc[d] = max(far_doc[d], j)
        if least > ERRORS:
            break
    for e in range(1, ERRORS + 1):
        far_item[e], far_doc[e] = max(far_item[e], far_item[e - 1]), max(far_doc[e], far_doc[e - 1])
    return far_item, far_doc


def holds(doc: list[str], item: list[str], p: int, q: int) -> bool:
    """Whether a passage stands around position p of ``doc``, where the item's piece from q on stands."""
    side = LONGEST - PIECE + ERRORS
    left_item, left_doc = reach(item[max(0, q - side) : q][::-1], doc[max(0, p - side) : p][::-1])
    right_item, right_doc = reach(item[q + PIECE : q + PIECE + side], doc[p + PIECE : p + PIECE + side])
    if left_item[0] + PIECE + right_item[0] >= RUN:
        return True
    for a in range(ERRORS + 1):
        for b in range(ERRORS + 1 - a):
            longest = PIECE + max(left_item[a] + right_item[b], left_doc[a] + right_doc[b])
            if longest >= max(STRETCH, PER_ERROR * (a + b)):
                return True
    return False


class Item(NamedTuple):
    """A part of a test item: its words with compounds split, and with compounds whole if it has any."""

    id: int
    simple: list[str]
    whole: list[str] | None

    @classmethod
    def of(cls, id: int, compounds: list[str]) -> Item:
        return cls(id, simple(compounds), compounds if any("-" in w for w in compounds) else None)


def _automaton(items: list[Item]):
    """Automaton of all pieces; a piece's value is the places (index of item, position) it stands at."""
    places: dict[str, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        w = item.simple
        for q in range(len(w) - PIECE + 1):
            places.setdefault(f" {' '.join(w[q : q + PIECE])} ", []).append((i, q))
    if not places:
        return None
    auto = ahocorasick.Automaton()
    for piece, where in places.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto


def _whole(doc: list[str], item: list[str]) -> bool:
    """Whether ``doc`` holds a passage of ``item``, both with whole compounds."""
    places: dict[tuple, list[int]] = {}
    for q in range(len(item) - PIECE + 1):
        places.setdefault(tuple(item[q : q + PIECE]), []).append(q)
    return any(holds(doc, item, p, q) for p in range(len(doc) - PIECE + 1) for q in places.get(tuple(doc[p : p + PIECE]), ()))


def leaked(compounds: list[str], items: list[Item], auto) -> list[int]:
    """Ids of the items of which a document of these words holds a passage."""
    doc = simple(compounds)
    hits = list(auto.iter(f" {' '.join(doc)} "))
    if not hits:
        return []
    starts, at = [], 1
    for w in doc:
        starts.append(at)
        at += len(w) + 1
    found: set[int] = set()
    tried: set[tuple] = set()
    met: set[int] = set()
    side = LONGEST - PIECE + ERRORS
    for end, (length, where) in hits:
        p = bisect_right(starts, end - length + 2) - 1
        around = None
        for i, q in where:
            item = items[i]
            if item.id in found:
                continue
            if item.whole:
                met.add(i)
            around = around or (min(p, side), tuple(doc[max(0, p - side) : p + PIECE + side]))
            key = (i, q, around)  # the same words around the same piece were tried before
            if key in tried:
                continue
            tried.add(key)
            if holds(doc, item.simple, p, q):
                found.add(item.id)
    for i in met:
        if items[i].id not in found and _whole(compounds, items[i].whole):
            found.add(items[i].id)
    return sorted(found)


def _item_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as words; long ones in overlapping parts."""
    for b in batches:
        ids, parts, sizes = [], [], []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = words(text)
            for a in range(0, max(len(w) - SHARED, 1), PART - SHARED):
                part = w[a : a + PART]
                if len(part) >= RUN:
                    ids.append(item)
                    parts.append(" ".join(part))
                    sizes.append(len(part))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(sizes, pa.int64())], ["item_id", "words", "size"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])


_automata: dict[str, tuple] = {}


def _searcher(shared, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = shared.value
        if key not in _automata:  # once a worker
            _automata.clear()
            items = [Item.of(i, w.split(" ")) for i, w in held]
            _automata[key] = items, _automaton(items)
        items, auto = _automata[key]
        split = str.split if cut else words
        for b in batches:
            docs, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if auto is not None and (hit := leaked(split(text), items, auto)):
                    docs += [doc] * len(hit)
                    ids += hit
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id`` of every item a passage of which stands in a document.

    Null and empty texts, of documents or items, hold nothing; of an item id that occurs with
    several texts each counts; an item of fewer than 12 words can't leak.  A text of any length is read whole.
    Empty tables give no rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''")
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    parts = materialize(held.mapInArrow(_item_parts, "item_id bigint, words string, size bigint"), "items")
    n = -(-(parts.agg(F.sum("size")).first()[0] or 0) // block)
    if not n:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    if n > 1:  # words are cut once for all blocks
        texts = materialize(texts.mapInArrow(_cut, "doc_id bigint, text string"), "words")
    found = []
    for k in range(n):  # the query set in blocks of a bounded size
        of = parts if n == 1 else parts.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.words) for r in of.collect()]))
        found.append(texts.mapInArrow(_searcher(shared, n > 1), "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, found).distinct()
