"""Runs of repeated consecutive events collapsed to one event each (problem 5).

Symbol strings: within a chunk of a report every entry becomes one Unicode character, the
same for entries that are equal once numbers, ids, times, case and white space are taken out
of their messages; what separates sections becomes a line feed.  The regular expression
``([^\\n])\\1+`` finds the repetitions and its spans are mapped back to lines and times.

A run may cross chunks, and a report of any length is many chunks: the first and last
repetition of each chunk go through a second, small step that joins those that touch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.entries import blocks
from strataline.operators.instants import parsed_instants
from strataline.operators.parsing import parse_lines
from strataline.session import CHUNK_LINES, materialize

_repeated = re.compile(r"([^\n])\1+", re.S).finditer
_RUNS = (
    "report_id bigint, chunk bigint, first_line bigint, last_line bigint, n_events bigint, first_micros bigint, last_micros bigint, "
    "level_id int, component string, message_hash bigint, from_start boolean, to_end boolean"
)
_SCHEMA = pa.schema(
    [("report_id", pa.int64()), ("chunk", pa.int64()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("n_events", pa.int64()), ("first_micros", pa.int64()), ("last_micros", pa.int64())]
    + [("level_id", pa.int32()), ("component", pa.string()), ("message_hash", pa.int64()), ("from_start", pa.bool_()), ("to_end", pa.bool_())]
)


def symbol_string(codes: np.ndarray) -> str:
    """One character per event, equal for equal codes, from U+0100 on without surrogates; a negative code separates and
    becomes a line feed."""
    points = np.where(codes < 0, 10, 256 + codes + np.where(codes >= 0xD700, 0x800, 0))
    return points.astype("<u4").tobytes().decode("utf-32-le")


def spans(text: str) -> list[tuple[int, int]]:
    """Longest repetitions of a symbol as (first, last) positions, and the symbols at both ends even if they stand alone."""
    out = [(m.start(), m.end() - 1) for m in _repeated(text)]
    last = len(text) - 1
    if text and text[0] != "\n" and not (out and out[0][0] == 0):
        out.insert(0, (0, 0))
    if last > 0 and text[last] != "\n" and not (out and out[-1][1] == last):
        out.append((last, last))
    return out


def _chunk_runs(key, group):
    g = group.sort_by("first_line").combine_chunks()
    first, last = (g.column(c).to_numpy() for c in ("first_line", "last_line"))
    names = g.column("component").chunk(0).dictionary_encode()
    number = lambda c: g.column(c).fill_null(-1).to_numpy()
    told = np.stack([number("level_id"), names.indices.fill_null(-1).to_numpy(), number("message_hash")], axis=1)
    codes = np.unique(told, axis=0, return_inverse=True)[1].reshape(-1)
    text = symbol_string(np.where(g.column("entry").to_numpy(), codes, -1))
    at, level, component, message = (g.column(c) for c in ("at_micros", "level_id", "component", "message_hash"))
    rows = []
    for a, b in spans(text):
        known = [x for x in at[a : b + 1].to_pylist() if x is not None]
        same = (c[a].as_py() for c in (level, component, message))
        rows.append((key[0].as_py(), key[1].as_py(), int(first[a]), int(last[b]), b - a + 1, min(known, default=None), max(known, default=None), *same, a == 0, b == len(text) - 1))
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def collapse(events: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Runs of two or more events, from ``blocks``: ``report_id, first_line, last_line, n_events, level_id,
    component, first_micros, last_micros``."""
    if "at_micros" not in events.columns:
        events = events.withColumn("at_micros", F.lit(None).cast("bigint"))
    events = events.select("report_id", "first_line", "last_line", "entry", "level_id", "component", "message_hash", "at_micros")
    chunked = events.withColumn("chunk", F.floor(F.col("first_line") / F.lit(size)).cast("bigint"))
    found = chunked.groupBy("report_id", "chunk").applyInArrow(_chunk_runs, _RUNS)
    # Ends that touch: the last run of a chunk and the first of the report's next chunk that has any.
    order = Window.partitionBy("report_id").orderBy("first_line")
    edge = F.col("from_start") | F.col("to_end")
    same = (
        F.col("from_start")
        & F.lag("to_end").over(order)
        & F.lag("level_id").over(order).eqNullSafe(F.col("level_id"))
        & F.lag("component").over(order).eqNullSafe(F.col("component"))
        & F.lag("message_hash").over(order).eqNullSafe(F.col("message_hash"))
    )
    out = ["report_id", "first_line", "last_line", "n_events", "level_id", "component", "first_micros", "last_micros"]
    found = materialize(found, "runs")
    joined = (
        found.where(edge)
        .withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("report_id", "_island")
        .agg(
            F.min("first_line").alias("first_line"),
            F.max("last_line").alias("last_line"),
            F.sum("n_events").alias("n_events"),
            F.first("level_id").alias("level_id"),
            F.first("component").alias("component"),
            F.min("first_micros").alias("first_micros"),
            F.max("last_micros").alias("last_micros"),
        )
    )
    return found.where(~edge).select(*out).unionByName(joined.select(*out)).where("n_events >= 2")


def event_runs(lines: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Every longest run of two or more log entries of the same level, component and message that follow
    each other in one section: ``report_id, first_line, last_line, n_events, level_id, component,
    first_micros, last_micros``.

    With ``reports`` the times are those of the run's entries, null where none is known; without, all null.
    Null content is ignored, repeated lines count once, an empty table gives no rows, extra
    columns are ignored.
    """
    parsed = materialize(parse_lines(lines, times=reports is not None, messages=True), "parsed")
    # an entry without time asks for its first line, which has none, so that these spread too
    events = blocks(parsed).withColumn("time_line", F.coalesce("time_line", "first_line"))
    if reports is not None:
        at = parsed_instants(parsed, reports).select("report_id", F.col("line_number").alias("time_line"), F.col("utc_micros").alias("at_micros"))
        events = events.join(at, ["report_id", "time_line"], "left")
    return collapse(events)
