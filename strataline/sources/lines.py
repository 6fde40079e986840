"""Lines: from text files, from text columns, from the query results table; ranges, points, counts, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions.textnorm import text_pieces, valid_text
from strataline.session import CHUNK_LINES, small

#: Columns that name a source of lines.
SOURCE = "report_id"


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_number, content`` of text files, numbered from 1 in each file.

    Files are split freely; lines are counted per block of a file, and running sums of the
    counts, one row a block, give each block its offset, so no file is numbered in one task.
    Ends of lines are line feed, carriage return or both; invalid UTF-8 bytes are dropped.
    An empty file has no lines.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), valid_text(F.col("value")).alias("content")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("file", "block").orderBy("_at")
    numbered = raw.withColumn("_row", F.row_number().over(inside)).join(small(offsets), ["file", "block"])
    return numbered.select("file", (F.col("_row") + F.col("_offset")).cast("bigint").alias("line_number"), "content")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_number, content`` of a text column.  Null and empty texts have no lines."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.posexplode(text_pieces(F.col(text))).alias("_p", "content")).select(
        key, (F.col("_p") + 1).cast("bigint").alias("line_number"), "content"
    )


def report_lines(results: DataFrame) -> DataFrame:
    """Each line of the query results once: ``report_id, line_number, content``.

    The non-null copies of a line are equal, so repeats are whole rows, and what is asked of a line is asked before
    they are removed: only the lines that meet it are shuffled.  A line with no content has no row.
    """
    return line_rows(results).distinct()


def line_rows(results: DataFrame) -> DataFrame:
    """The rows of the query results that carry a line's text, repeats included: for operators that shuffle less than the text."""
    return results.where("content is not null and report_id is not null and line_number is not null").select("report_id", "line_number", "content")


def places(results: DataFrame) -> DataFrame:
    """``report_id, line_number`` of each line once."""
    return line_rows(results).select("report_id", "line_number").distinct()


def once(df: DataFrame, unique: bool) -> DataFrame:
    """``df``, without repeats unless its lines are ``unique`` already."""
    return df if unique else df.distinct()


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines from ``first`` to ``last``, both included, of every source."""
    return lines.where(F.col("line_number").between(first, last))


def line_at(lines: DataFrame, number: int) -> DataFrame:
    """One line of every source, no row where it is absent."""
    return lines.where(F.col("line_number") == number)


def up_to(lines: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` lines of every source; all for None."""
    return lines if most is None else lines.where(F.col("line_number") <= most)


def line_counts(lines: DataFrame, by: str = SOURCE) -> DataFrame:
    return lines.groupBy(by).agg(F.count("*").alias("n_lines"))


def read_until(lines: DataFrame, pattern: str, by: str = SOURCE) -> DataFrame:
    """Lines of each source up to and including its first line that matches; all of a source without one."""
    stop = lines.where(F.col("content").rlike(pattern)).groupBy(by).agg(F.min("line_number").alias("_stop"))
    return lines.join(small(stop), by, "left").where("_stop is null or line_number <= _stop").drop("_stop")


def emit(lines: DataFrame, processor: Column, name: str = "value") -> DataFrame:
    """What ``processor`` makes of each line, where that is neither null, empty nor false."""
    made = lines.withColumn(name, processor)
    kind = dict(made.dtypes)[name]
    kept = F.col(name) if kind == "boolean" else F.col(name).isNotNull() & ((F.col(name) != "") if kind == "string" else F.lit(True))
    return made.where(kept)


def running_before(df: DataFrame, value: str, by: str = SOURCE, size: int = CHUNK_LINES) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the earlier lines of its source.

    Sums run within chunks of line numbers; the sums of whole chunks run over one row a chunk.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col("line_number") / F.lit(size)).cast("bigint"))
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(by, "_chunk").agg(F.sum(value).alias("_sum")).select(by, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_chunk").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    summed = chunked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(small(totals), [by, "_chunk"]).withColumn("before", (F.col("_in") + F.col("_base")).cast("bigint")).drop("_in", "_base", "_chunk")


def byte_offsets(lines: DataFrame, terminator: int = 1, unique: bool = True) -> DataFrame:
    """``report_id, line_number, byte_offset`` of each line in a file of these lines; ``unique``: no line is repeated."""
    sized = once(lines.select(SOURCE, "line_number", (F.octet_length("content") + terminator).cast("bigint").alias("_size")), unique)
    return running_before(sized, "_size").select(SOURCE, "line_number", F.col("before").alias("byte_offset"))
