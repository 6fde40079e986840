"""Reports that are still being written: the line operators on streams.

Line numbers need the whole source before a line, so streams carry their own number (the producer's
offset); operators that look at one line at a time (markers, keywords, fields, times) run as they are.
Counts are by event time with a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.boundaries import match_types
from strataline.operators.index import keyword_index

STREAM_SCHEMA = "report_id bigint, line_number bigint, content string, ts timestamp"


def read_lines(spark: SparkSession, path: str, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    """Stream of ``STREAM_SCHEMA`` rows from files arriving under ``path``."""
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(fmt).load(path)


def markers(stream: DataFrame) -> DataFrame:
    return stream.withColumn("match_types", match_types(F.col("content"))).where(F.size("match_types") > 0)


def keyword_rate(stream: DataFrame, keywords: list[str], window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``keyword, window_start, window_end, n_hits`` over windows of event time.

    Lines later than ``late`` are left out, as the watermark has it; repeats of a line within it count once.
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["report_id", "line_number"])
    hits = keyword_index(once, keywords, ("report_id", "ts"))
    span: Column = F.window("ts", window, slide) if slide else F.window("ts", window)
    return hits.groupBy("keyword", span.alias("w")).agg(F.count("*").alias("n_hits")).select("keyword", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_hits")


def quiet_spells(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each report: ``report_id, started, ended, n_lines`` between pauses of ``gap``."""
    s = stream.withWatermark("ts", late).groupBy("report_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_lines"))
    return s.select("report_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_lines")
