"""Fields of lines, times stated in them, queries by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.textnorm import like_python
from strataline.operators.catalog import LINE_PATTERNS

# How a line states its time; the first that matches counts.
TIME_PATTERNS = (
    ("logcat", r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})"),
    ("kernel", r"^\[\s*(\d+\.\d+)\]"),
    ("dumpsys", r"ending at:\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"),
    ("system", r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"),
)


def line_fields(lines: DataFrame, pattern: str, keys: tuple[str, ...] = ("report_id", "line_number")) -> DataFrame:
    """Fields of the lines that match a named line pattern, empty ones as null."""
    regex, names = LINE_PATTERNS[pattern]
    regex = like_python(regex)
    matched = lines.where(F.col("content").rlike(regex))
    return matched.select(*keys, *[F.nullif(F.regexp_extract("content", regex, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)])


def stated_time(content: Column, year: Column | int) -> tuple[Column, Column]:
    """Name of the format and time of a line (without zone; a kernel time counts from 1970); nulls where none is stated.
    Notations without year get ``year``."""
    squeezed = lambda p: F.regexp_replace(F.regexp_extract(content, p, 1), r"\s+", " ")
    y = year if isinstance(year, Column) else F.lit(year)
    kind, at = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    for name, p in reversed(TIME_PATTERNS):
        text = squeezed(p)
        if name == "kernel":
            t = F.timestamp_micros((text.try_cast("decimal(20,6)") * 1_000_000).cast("bigint")).cast("timestamp_ntz")
        else:
            full = text if name == "dumpsys" else F.concat(y.cast("string"), F.lit("-"), text)
            t = full.try_cast("timestamp_ntz")
        match = content.rlike(p)
        kind, at = F.when(match, F.lit(name)).otherwise(kind), F.when(match, t).otherwise(at)
    return kind, at


def timed(lines: DataFrame, year: Column | int) -> DataFrame:
    """Time index: ``report_id, line_number, time_format, ts`` of lines that state a time."""
    kind, at = stated_time(F.col("content"), year)
    return lines.select("report_id", "line_number", kind.alias("time_format"), at.alias("ts")).where("ts is not null")


def between(times: DataFrame, start: str, end: str) -> DataFrame:
    """Entries of a time index within a range, both ends included."""
    return times.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def time_context(times: DataFrame, hits: DataFrame, seconds_before: int, seconds_after: int, bucket: int | None = None) -> DataFrame:
    """``report_id, line_number`` of lines within some seconds of any hit of their report.

    Hits are laid over buckets of time, so the join is on (report, bucket).
    """
    width = bucket or max(seconds_before + seconds_after, 1)
    slot = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / F.lit(width)).cast("bigint")
    span = lambda n: F.make_interval(secs=F.lit(n))
    at = hits.select("report_id", "line_number").join(times, ["report_id", "line_number"]).select(
        "report_id", (F.col("ts") - span(seconds_before)).alias("_from"), (F.col("ts") + span(seconds_after)).alias("_to")
    ).distinct()
    laid = at.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
    near = times.withColumn("_slot", slot(F.col("ts"))).join(laid, ["report_id", "_slot"]).where("ts between _from and _to")
    return near.select("report_id", "line_number").distinct()
