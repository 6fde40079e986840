"""Log lines to features, by shape signatures (problem 3, first half).

1. `signature_rules`: one pass emits each signature a task sees once; the distinct
   signatures are resolved to extraction rules, each one time, in a distributed stage.
   The table signature -> rule is broadcast when it has at most ``SIGNATURE_BOUND`` rows;
   beyond that it isn't collected at all and workers resolve signatures as they meet
   them, with the same function and therefore the same result.
2. `parse_lines`: the second pass looks up each line's rule and runs only that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import layouts as L

#: Most signatures that are broadcast (about 40 bytes each).
SIGNATURE_BOUND = 250_000
#: Heads of lines a worker remembers.
HEADS = 300_000

#: Places a task remembers to drop copies of a line before the shuffle.
COMBINED = 200_000

PARSED = (
    "report_id bigint, line_number bigint, kind tinyint, level tinyint, component string, message_hash bigint, "
    "clock tinyint, micros bigint, swapped bigint, zone_offset int, zone_abbr string"
)


def text_lines(lines: DataFrame) -> DataFrame:
    """Rows of ``report_id, line_number, content`` that carry text and have a place.

    A line may be repeated; copies without content are dropped, as are rows without
    report or line number.  Other columns are ignored, whatever their names.
    """
    return lines.select(
        F.col("report_id").cast("bigint").alias("report_id"), F.col("line_number").cast("bigint").alias("line_number"), F.col("content").cast("string").alias("content")
    ).where("content is not null and report_id is not null and line_number is not null")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    heads: set[bytes] = set()  # many lines share a head, many heads a signature
    for batch in batches:
        fresh = set(map(L.head, batch.column(0).to_pylist())) - heads
        if len(heads) < HEADS:
            heads |= fresh
        new = set(map(L.collapse, fresh)) - seen
        if len(seen) < HEADS:
            seen |= new
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary())], ["signature"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(list(map(L.resolve, sigs)), pa.int32())], ["signature", "rule"])


def signature_rules(lines: DataFrame) -> DataFrame:
    """``signature, rule`` of every distinct signature of ``lines``; rule -1 for continuations."""
    sigs = text_lines(lines).select("content").mapInArrow(_signatures, "signature binary").distinct()
    return sigs.mapInArrow(_resolve, "signature binary, rule int")


def broadcast_rules(lines: DataFrame):
    rows = signature_rules(lines).limit(SIGNATURE_BOUND + 1).toArrow()
    known = dict(zip(rows["signature"].to_pylist(), rows["rule"].to_pylist())) if rows.num_rows <= SIGNATURE_BOUND else {}
    return lines.sparkSession.sparkContext.broadcast(known)


class Rules(dict):
    """Rule of a line's head: by the broadcast rule of its signature, remembered for the head; a signature that
    isn't among the broadcast ones is resolved here."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known

    def __missing__(self, head: bytes) -> int:
        if len(self) > HEADS:
            self.clear()
        sig = L.collapse(head)
        rule = self.known.get(sig)
        out = self[head] = L.resolve(sig) if rule is None else rule
        return out


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _parser(known, times: bool, fields: bool, messages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, seen = Rules(known.value), set()
        head, extract, canonical = L.head, L.extract, L.canonical
        for batch in batches:
            rid, num = batch.column(0), batch.column(1)
            keep, found, hashes = [], [], []
            places = zip(rid.to_pylist(), num.to_pylist())
            for i, (text, place) in enumerate(zip(batch.column(2).to_pylist(), places)):
                if place in seen:  # a copy; combined here so that no line, however often repeated, reaches one task whole
                    continue
                if len(seen) >= COMBINED:
                    seen.clear()
                seen.add(place)
                rule = rules[head(text)]
                if rule < 0:
                    if fields:
                        keep.append(i)
                        found.append(L._CONTINUATION)
                        if messages:
                            hashes.append(_hash(canonical(text)))
                    continue
                f = extract(rule, text)
                if fields or f.clock:
                    keep.append(i)
                    found.append(f)
                    if messages:
                        hashes.append(_hash(canonical(text if f.kind == L.CONT else f.message)))
            index = pa.array(keep, pa.int64())
            kind, level, component, _, clock, micros, swapped, offset, abbr = zip(*found) if found else [()] * 9
            none = pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    rid.take(index),
                    num.take(index),
                    pa.array(kind, pa.int8()),
                    pa.array(level, pa.int8()) if fields else none.cast(pa.int8()),
                    pa.array(component, pa.string()) if fields else none.cast(pa.string()),
                    pa.array(hashes, pa.int64()) if messages else none,
                    pa.array(clock, pa.int8()) if times else none.cast(pa.int8()),
                    pa.array(micros, pa.int64()) if times else none,
                    pa.array(swapped, pa.int64()) if times else none,
                    pa.array(offset, pa.int32()) if times else none.cast(pa.int32()),
                    pa.array(abbr, pa.string()) if times else none.cast(pa.string()),
                ],
                ["report_id", "line_number", "kind", "level", "component", "message_hash", "clock", "micros", "swapped", "zone_offset", "zone_abbr"],
            )

    return run


def parse_lines(lines: DataFrame, times: bool = False, fields: bool = True, messages: bool = False) -> DataFrame:
    """One row (schema ``PARSED``) for each row of ``lines`` with content.

    ``fields``: kind, level and component of every line; without it only lines that state
    a time come out.  ``messages``: hash of the canonical message.  ``times``: the clock.
    Copies of a line are combined within a task, so some may come out more than once, all
    alike; lines of any length are read whole.  An empty table
    gives no rows.
    """
    text = text_lines(lines)
    return text.mapInArrow(_parser(broadcast_rules(lines), times, fields, messages), PARSED)
