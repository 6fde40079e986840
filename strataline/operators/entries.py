"""Log entries with all their lines (problem 3, second half).

Continuation lines attach backward to the entry before them.  Reports are ordered in
chunks of ``CHUNK_LINES`` line numbers, never whole: a chunk finds the entry each of its lines
belongs to by a window within the chunk, and what it can't know, the entry that was open
when the chunk began, comes from one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import layouts as L
from strataline.operators.parsing import parse_lines
from strataline.session import CHUNK_LINES, materialize, small

_OPENS = (L.START, L.JUL, L.JOPEN, L.STOP, L.STAMP)


def with_chunk(df: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("line_number") / F.lit(size)).cast("bigint"))


def attach(parsed: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """``parsed`` without repeated lines, with ``opened``: the line that opened what this line belongs to.

    ``parsed`` is read twice; hand in a table, not a long plan.
    """
    opens = F.col("kind").isin(*_OPENS)
    lines = with_chunk(parsed, size)
    summary = lines.groupBy("report_id", "chunk").agg(F.max(F.when(opens, F.col("line_number"))).alias("last_open"))
    before = Window.partitionBy("report_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("report_id", "chunk", F.last("last_open", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("report_id", "chunk").orderBy("line_number")
    placed = (
        lines.withColumn("_previous", F.lag("line_number").over(order))
        .withColumn("_open", F.last(F.when(opens, F.col("line_number")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_previous is null or _previous <> line_number")
    )
    return placed.join(small(carry), ["report_id", "chunk"], "left").withColumn("opened", F.coalesce("_open", "carried")).drop("_previous", "_open", "carried", "chunk")


def blocks(parsed: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Entries of parsed lines, and what separates them: ``report_id, first_line, last_line, entry, level_id,
    component, message_hash, time_line``; ``entry`` is false for headings, durations, traces and dumps.

    The level of an entry is that of its first line, else of the line after it, or of its
    fields, as its layout has it; ``message_hash`` covers all its lines in order (null where
    the parse had no messages); ``time_line`` is the line that states the entry's own time (null where the parse
    had no times).
    """
    at, kind = F.col("line_number") - F.col("opened"), F.col("kind")
    opening = at == 0
    states = lambda c: F.max(F.when(c & (F.col("clock") > 0), F.col("line_number")))
    whole = (
        attach(parsed, size)
        .where("opened is not null")
        .groupBy("report_id", "opened")
        .agg(
            F.max("line_number").alias("last_line"),
            F.max(F.when(opening, kind)).alias("kind"),
            F.max(F.when(opening, F.col("level"))).alias("own"),
            F.max(F.when((at == 1) & (kind == L.LEVELLED), F.col("level"))).alias("next"),
            F.max(F.when(kind == L.FIELD, F.col("level"))).alias("field"),
            F.max(F.when(opening, F.col("component"))).alias("component"),
            F.max(F.when(kind == L.FIELD, F.col("component"))).alias("field_component"),
            F.bit_xor(F.xxhash64(F.col("message_hash"), at)).alias("message_hash"),
            F.coalesce(states(opening), states(kind == L.FIELD)).alias("time_line"),
        )
    )
    braces = F.col("kind") == L.JOPEN
    level = F.when(braces, F.col("field")).when(F.col("kind") == L.JUL, F.col("next")).otherwise(F.col("own")).cast("int")
    return whole.select(
        "report_id",
        F.col("opened").alias("first_line"),
        "last_line",
        (F.col("kind").isin(L.START, L.JUL, L.JOPEN) & (F.coalesce(level, F.lit(0)) > 0)).alias("entry"),
        level.alias("level_id"),
        F.when(braces, F.col("field_component")).otherwise(F.col("component")).alias("component"),
        "message_hash",
        "time_line",
    )


def log_entries(lines: DataFrame) -> DataFrame:
    """Every log entry of ``lines(report_id, line_number, content)``:
    ``report_id, first_line, last_line, log_level, component``.

    Nulls: rows without content, report or line number are ignored.  Repeated lines count
    once.  Lines before the first entry of a report, headings, durations, traces, dumps and
    properties belong to no entry.  An empty table gives no rows; extra columns are ignored.
    """
    parsed = materialize(parse_lines(lines), "parsed")
    names = F.array(*map(F.lit, L.LEVELS))
    return blocks(parsed).where("entry").select("report_id", "first_line", "last_line", F.element_at(names, F.col("level_id")).alias("log_level"), "component")
