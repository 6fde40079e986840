"""Results for each key where a few keys hold most records (problem 4).

Exact offset chunking:

1. Rows are range-partitioned by (key, report, line), so that a heavy key is spread over as many
   partitions as its rows need, and sorted there.  Equal rows meet in one partition, next to each other; repeats
   go, and rows are numbered within (partition, key), in one streaming pass.
2. Keys are counted per partition (partial aggregation; a few rows a partition), and running
   sums of the counts in partition order are the exact offsets of each partition in each key.
3. The offset is added to a row's number: every row has its exact
   ordinal in its key, found by one shuffle and without any key in one task.
4. Ordinals cut each key into chunks of equal size; each chunk is aggregated alone.
5. The chunks' ordered states (count, first and last report and line, distinct reports, widest gap)
   are merged in order; what two neighbours share at their border counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.textnorm import stripped
from strataline.session import materialize, small

#: Rows of a key that are aggregated at a time.
KEY_CHUNK = 100_000


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order: without repeats, with their number in (partition, key) and whether the row before is of
    the same key and report."""
    last, n = None, 0  # the row before, and how many distinct rows of its key there were
    for b in batches:
        if not b.num_rows:
            continue
        key, report, line = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
        same_key = np.r_[last is not None and key[0].as_py() == last[0], pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]
        same_report = same_key & np.r_[last is not None and report[0] == last[1], report[1:] == report[:-1]]
        kept = ~(same_report & np.r_[last is not None and line[0] == last[2], line[1:] == line[:-1]])
        count = np.cumsum(kept)
        begun = np.maximum.accumulate(np.where(same_key, -1, np.arange(len(line))))  # where the key begins in this batch
        number = count - np.where(begun >= 0, count[begun] - 1, -n)
        last, n = (key[-1].as_py(), report[-1], line[-1]), int(number[-1])
        index = pa.array(np.flatnonzero(kept))
        yield pa.RecordBatch.from_arrays([c.take(index) for c in (*b.columns, pa.array(number), pa.array(same_report))], [*b.schema.names, "_row", "same_report"])


def number_hits(hits: DataFrame, name: str = "hits") -> DataFrame:
    """Distinct ``key_name, report_id, line_number`` of ``hits``, with ``hit_no``: its exact ordinal, from 1, in its key
    ordered by report and line; ``part``: the partition it lies in; ``same_report``: whether the row before is of its report.
    Rows with a null aren't hits."""
    keys = ["key_name", "report_id", "line_number"]
    ordered = hits.select(F.col("key_name").cast("string"), *(F.col(c).cast("bigint") for c in keys[1:])).dropna().repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_number, "key_name string, report_id bigint, line_number bigint, part int, _row bigint, same_report boolean")
    placed = materialize(rows, name)
    counts = placed.groupBy("key_name", "part").agg(F.max("_row").alias("n"))
    before = Window.partitionBy("key_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key_name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(small(offsets), ["key_name", "part"]).select(*keys, "part", (F.col("_row") + F.col("offset")).alias("hit_no"), "same_report")


def chunk_states(numbered: DataFrame, chunk: int = KEY_CHUNK) -> DataFrame:
    """State of each chunk of each key: cut at every ``chunk``-th ordinal and where a partition ends."""
    starts = (F.col("hit_no") - 1) % chunk == 0
    return numbered.groupBy("key_name", "part", F.floor((F.col("hit_no") - 1) / F.lit(chunk)).cast("bigint").alias("chunk")).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("same_report") | starts).alias("reports"),
        F.min_by("report_id", "hit_no").alias("first_report"),
        F.min_by("line_number", "hit_no").alias("first_line"),
        F.max_by("report_id", "hit_no").alias("last_report"),
        F.max_by("line_number", "hit_no").alias("last_line"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """``key_name, n_hits, n_reports, first_report, first_line, last_report, last_line`` by merging each key's chunks in
    order: a report on both sides of a border counts once."""
    order = Window.partitionBy("key_name").orderBy("part", "chunk")
    shared = F.when(F.lag("last_report").over(order) == F.col("first_report"), 1).otherwise(0)
    ordinal = F.struct("part", "chunk")
    return (
        states.withColumn("_shared", shared)
        .groupBy("key_name")
        .agg(
            F.sum("n").alias("n_hits"),
            (F.sum("reports") - F.sum("_shared")).alias("n_reports"),
            *(F.min_by(c, ordinal).alias(c) for c in ("first_report", "first_line")),
            *(F.max_by(c, ordinal).alias(c) for c in ("last_report", "last_line")),
        )
    )


def key_results(hits: DataFrame, name: str = "hits", chunk: int = KEY_CHUNK) -> DataFrame:
    """Results of each key of ``hits(key_name, report_id, line_number)``, however many rows it has.

    Hits are distinct; rows with a null in any of the three columns aren't hits.  An empty table
    gives no rows.
    """
    return merge_states(chunk_states(number_hits(hits, name), chunk))


def keyword_hits(index: DataFrame) -> DataFrame:
    """Hits of the keyword index: keywords trimmed and in lower case."""
    return index.select(F.lower(stripped(F.col("keyword"))).alias("key_name"), F.col("report_id").cast("bigint").alias("report_id"), F.col("line_number").cast("bigint").alias("line_number"))


def query_hits(index: DataFrame) -> DataFrame:
    """Hits of the custom index: elements of its arrays, null and empty arrays and null elements left out."""
    return index.select(F.col("query_name").alias("key_name"), F.col("report_id").cast("bigint").alias("report_id"), F.explode("line_numbers").alias("line_number"))


def heavy(results: DataFrame, share: float) -> DataFrame:
    """Keys with at least ``share`` of all hits."""
    total = results.agg(F.sum("n_hits").alias("total")).first().total or 0
    return results.where(F.col("n_hits") >= F.lit(share * total))


def heavy_keys(enhanced: DataFrame, custom: DataFrame, keyword_share: float = 0.02, query_share: float = 0.05) -> DataFrame:
    """``index_name, key_name`` of the keys that hold at least the given share of their index's distinct hits."""
    parts = [
        (F.lit("enhanced_index"), materialize(key_results(keyword_hits(enhanced), "keyword-hits"), "keyword-results"), keyword_share),
        (F.lit("custom_index"), materialize(key_results(query_hits(custom), "query-hits"), "query-results"), query_share),
    ]
    found = [heavy(r, s).select(n.alias("index_name"), "key_name") for n, r, s in parts]
    return found[0].unionByName(found[1])
