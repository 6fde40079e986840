"""Queries of the training-data problems that live in the core: 1, 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.entries import log_entries
from strataline.operators.heavykeys import heavy_keys, key_results, keyword_hits, query_hits
from strataline.operators.instants import instants
from strataline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(table(spark, sf_dir, "query_results"), table(spark, sf_dir, "reports"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(table(spark, sf_dir, "query_results"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "enhanced_index"), table(spark, sf_dir, "custom_index"))


def p4_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every key of both indexes."""
    keywords = key_results(keyword_hits(table(spark, sf_dir, "enhanced_index")), "keyword-hits")
    queries = key_results(query_hits(table(spark, sf_dir, "custom_index")), "query-hits")
    return keywords.select(F.lit("enhanced_index").alias("index_name"), "*").unionByName(queries.select(F.lit("custom_index").alias("index_name"), "*"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_results": p4_results}

_HITS = r"""
with hits as (
  select 'enhanced_index' index_name, regexp_replace(lower(keyword), '^\s+|\s+$', '', 'g') key_name, report_id, line_number
  from enhanced_index where keyword is not null and report_id is not null and line_number is not null
  union
  select 'custom_index', query_name, report_id, line_number
  from (select query_name, report_id, unnest(line_numbers) line_number from custom_index)
  where query_name is not null and report_id is not null and line_number is not null),
per_key as (
  select index_name, key_name, count(*) n_hits, count(distinct report_id) n_reports,
         min(report_id) first_report, arg_min(line_number, (report_id, line_number)) first_line,
         max(report_id) last_report, arg_max(line_number, (report_id, line_number)) last_line
  from hits group by all)
"""
ORACLES: dict[str, str] = {
    "p4_found": _HITS
    + """select index_name, key_name from per_key
      where n_hits >= case index_name when 'enhanced_index' then 0.02 else 0.05 end
            * (select sum(n_hits) from per_key p where p.index_name = per_key.index_name)""",
    "p4_results": _HITS + "select * from per_key",
}
