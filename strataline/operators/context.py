"""Context of hits, pages of results."""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.textnorm import right_stripped
from strataline.operators.heavykeys import number_hits
from strataline.session import small

# Fixed values of the page estimate.
CHARS_PER_LINE, CHARS_PER_TOKEN, LEAST_TOKENS = 100, 4, 10
DEFAULT_BEFORE, DEFAULT_AFTER, DEFAULT_TOKENS = 5, 5, 32_000
LISTED = 100
#: Pages in a file.
PAGES_PER_FILE = 1_000


def context_lines(lines: DataFrame, hits: DataFrame, before: int = DEFAULT_BEFORE, after: int = DEFAULT_AFTER, tolerant: bool = False) -> DataFrame:
    """``report_id, hit_line, side, line_number, content``: each hit (side ``hit``) and the lines around it.

    Contexts of neighbours aren't merged, and end where the report does.  Content loses white space at its end.
    A hit without a line gives nothing, or with ``tolerant`` a hit with empty content.  The join is on
    (report, line), so a report with many hits is spread.
    """
    places = hits.select("report_id", F.col("line_number").alias("hit_line")).distinct()
    around = places.withColumn("line_number", F.explode(F.sequence(F.col("hit_line") - before, F.col("hit_line") + after)))
    text = lines.select("report_id", "line_number", right_stripped(F.col("content")).alias("content"))
    side = F.when(F.col("line_number") < F.col("hit_line"), "before").when(F.col("line_number") > F.col("hit_line"), "after").otherwise("hit")
    joined = around.join(text, ["report_id", "line_number"], "left" if tolerant else "inner")
    if tolerant:
        joined = joined.where("content is not null or line_number = hit_line").withColumn("content", F.coalesce("content", F.lit("")))
    else:
        there = F.max(F.col("line_number") == F.col("hit_line")).over(Window.partitionBy("report_id", "hit_line"))
        joined = joined.withColumn("_there", there).where("_there").drop("_there")
    return joined.select("report_id", "hit_line", side.alias("side"), "line_number", "content")


def nested_context(long: DataFrame) -> DataFrame:
    """One row a hit: ``report_id, line_number, content, context struct<before, after>``."""
    row = F.struct("line_number", "content")
    part = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, row))).alias(s)
    return long.groupBy("report_id", "hit_line").agg(F.max(F.when(F.col("side") == "hit", F.col("content"))).alias("content"), part("before"), part("after")).select(
        "report_id", F.col("hit_line").alias("line_number"), "content", F.struct("before", "after").alias("context")
    )


def tokens_per_result(before: int = DEFAULT_BEFORE, after: int = DEFAULT_AFTER) -> int:
    return max(math.ceil((1 + before + after) * CHARS_PER_LINE / CHARS_PER_TOKEN), LEAST_TOKENS)


def page_size(max_tokens: int = DEFAULT_TOKENS, before: int = DEFAULT_BEFORE, after: int = DEFAULT_AFTER) -> int:
    return max(1, max_tokens // tokens_per_result(before, after))


def pages(hits: DataFrame, size: int) -> DataFrame:
    """``query_name, part, report_id, line_number``: hits of each query in pages of ``size``, ordered by report and line.

    Hits are numbered by exact offsets, so a query with most of all hits is not one task's.
    """
    numbered = number_hits(hits.select(F.col("query_name").alias("key_name"), "report_id", "line_number"), "pages")
    return numbered.select(F.col("key_name").alias("query_name"), (F.floor((F.col("hit_no") - 1) / F.lit(size)) + 1).cast("bigint").alias("part"), "report_id", "line_number")


def page_summary(paged: DataFrame) -> DataFrame:
    """``query_name, total_results, total_parts``."""
    return paged.groupBy("query_name").agg(F.count("*").alias("total_results"), F.max("part").alias("total_parts"))


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` hits by report and line: a top-n, not a cut of the input."""
    return hits.orderBy("report_id", "line_number").limit(n)


def page_rows(paged: DataFrame, context: DataFrame) -> DataFrame:
    """One row a page: ``query_name, part, pagination, results``; a page is at most as long as its size."""
    rows = paged.join(context, ["report_id", "line_number"])
    body = F.struct(*[c for c in rows.columns if c not in ("query_name", "part")])
    pages_ = rows.groupBy("query_name", "part").agg(F.sort_array(F.collect_list(body)).alias("results"))
    totals = page_summary(paged).select("query_name", "total_parts")
    pagination = F.struct("total_parts", F.col("part").alias("current_part"), F.size("results").alias("results_in_part"))
    return pages_.join(small(totals), "query_name").select("query_name", "part", pagination.alias("pagination"), "results")


def result_rows(paged: DataFrame, queries: DataFrame, before: int = DEFAULT_BEFORE, after: int = DEFAULT_AFTER, max_tokens: int = DEFAULT_TOKENS) -> DataFrame:
    """One row a query with hits: what its result file and its metadata say; ``line_numbers`` are the first ``LISTED`` places.

    ``queries(query_name, type, pattern, priority, description)`` are the queries' own columns.
    """
    size = page_size(max_tokens, before, after)
    # the first pages hold the first places, so no query's hits are ordered again
    first = paged.where(F.col("part") <= -(-LISTED // size)).groupBy("query_name").agg(F.slice(F.sort_array(F.collect_list(F.struct("report_id", "line_number"))), 1, LISTED).alias("line_numbers"))
    return (
        page_summary(paged)
        .join(first, "query_name", "left")
        .join(small(queries), "query_name", "left")
        .select(
            "query_name",
            "type",
            F.struct("type", "pattern", "priority", "description").alias("query_config"),
            F.col("total_results").alias("total_matches"),
            "total_results",
            "total_parts",
            F.lit(size).alias("results_per_part"),
            F.lit(before).alias("context_lines_before"),
            F.lit(after).alias("context_lines_after"),
            F.lit(max_tokens).alias("max_tokens_per_file"),
            (F.col("total_parts") + 2).alias("files_created"),
            "line_numbers",
            F.current_timestamp().alias("created_at"),
        )
    )


def write_pages(paged: DataFrame, context: DataFrame, results: DataFrame, root: str) -> DataFrame:
    """Write the pages as JSON lines, a page a row, under ``root/context/query_name=...`` and ``results`` under ``root/result``;
    what was written there, read back.  Queries without a hit have nothing.

    A file holds up to ``PAGES_PER_FILE`` pages, so there are as many files as results ask for, not one a page.
    """
    rows = page_rows(paged, context).repartition("query_name", F.floor(F.col("part") / F.lit(PAGES_PER_FILE)))
    rows.sortWithinPartitions("query_name", "part").write.mode("overwrite").partitionBy("query_name").json(f"{root}/context")
    results.write.mode("overwrite").json(f"{root}/result")
    return read_results(paged.sparkSession, root)


def write_single(paged: DataFrame, context: DataFrame, results: DataFrame, root: str) -> DataFrame:
    """Write all results of each query without pages, under ``root/context/query_name=...``, a result a row, for when pages are
    turned off; its number of parts is 1."""
    rows = paged.drop("part").join(context, ["report_id", "line_number"])
    rows.repartitionByRange("query_name", "report_id", "line_number").sortWithinPartitions("query_name", "report_id", "line_number").write.mode("overwrite").partitionBy("query_name").json(f"{root}/context")
    results.drop("results_per_part").withColumn("total_parts", F.lit(1)).withColumn("files_created", F.lit(2)).write.mode("overwrite").json(f"{root}/result")
    return read_results(paged.sparkSession, root)


def read_results(spark, root: str) -> DataFrame:
    return spark.read.json(f"{root}/result")


def read_pages(spark, root: str, query: str) -> DataFrame:
    """Pages of one query, as written."""
    return spark.read.json(f"{root}/context").where(F.col("query_name") == query)


def queries_with_results(spark, root: str) -> list[str]:
    """Names of the queries that have results under ``root``, on any file system."""
    return sorted(r.query_name for r in read_results(spark, root).select("query_name").collect())


def _dump(path: Path, data: dict) -> None:
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def export_files(spark, root: str, target: str, single: bool = False) -> int:
    """Files of written results in a local folder as users open them: for each query ``context/part_k.json`` (or all results in
    ``result.json`` with ``single``), ``result.json`` and ``metadata.json``.  Pages stream through one at a time.  How many files."""
    n = 0
    for r in read_results(spark, root).toLocalIterator():
        about = r.asDict(recursive=True)
        folder = Path(target) / re.sub(r"[^\w.-]", "_", r.query_name)
        (folder / "context").mkdir(parents=True, exist_ok=True)
        result = {"query": r.query_name, "type": about["type"], "total_matches": about["total_matches"]}
        meta = {k: about[k] for k in ("query_name", "query_config", "total_results", "created_at")}
        rows = read_pages(spark, root, r.query_name)
        if single:
            rows = rows.orderBy("report_id", "line_number").drop("query_name")
            with open(folder / "result.json", "w", encoding="utf-8") as f:
                f.write(json.dumps(result, ensure_ascii=False)[:-1] + ', "results": [')
                for i, row in enumerate(rows.toLocalIterator()):
                    f.write((",\n" if i else "\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False))
                f.write("]}\n")
            _dump(folder / "metadata.json", meta | {"files": {"result.json": "all results"}})
            n += 2
            continue
        for page in rows.orderBy("part").toLocalIterator():
            p = page.asDict(recursive=True)
            _dump(folder / "context" / f"part_{p['part']}.json", {"query": r.query_name, "pagination": p["pagination"], "results": p["results"]})
            n += 1
        around = {k: about[k] for k in ("context_lines_before", "context_lines_after")}
        pagination = {"total_parts": about["total_parts"], "results_per_part": about["results_per_part"]}
        _dump(folder / "result.json", result | {"pagination": pagination, "summary": {"total_results": about["total_results"], "total_pages": about["total_parts"], **around}, "line_numbers": about["line_numbers"]})
        _dump(folder / "metadata.json", meta | {"total_pages": about["total_parts"], "results_per_page": about["results_per_part"], "files": {"result.json": "summary", "context": f"{about['total_parts']} parts"}})
        n += 2
    return n
