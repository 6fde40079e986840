"""Keyword and token indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.textnorm import contained
from strataline.session import small

#: Words a token index leaves out, and the longest length it leaves out. Fixed values.
STOP_WORDS = ("the", "a", "an", "and", "or", "in", "on", "at", "to", "for")
SHORT = 2


def keyword_index(lines: DataFrame, keywords: list[str], keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """``keyword, keys..., line_number`` of every line that holds a keyword (case aside, no character special).

    One pass over the lines for any number of keywords; long form, so that no keyword's lines are gathered.
    """
    words = sorted({k.lower() for k in keywords if k})
    if not words:
        return lines.select(F.lit("").alias("keyword"), *keys, "line_number").where(F.lit(False))
    hits = contained(F.col("content"), words, words)
    return lines.select(F.explode(hits).alias("keyword"), *keys, "line_number")


def keyword_counts(index: DataFrame, keywords: list[str]) -> DataFrame:
    """``keyword, n_hits`` of every keyword of the catalogue, those without a hit with 0."""
    spark = index.sparkSession
    every = spark.createDataFrame([(k,) for k in sorted({k.lower() for k in keywords})], "keyword string")
    counts = index.groupBy("keyword").agg(F.count("*").alias("n_hits"))
    return every.join(small(counts), "keyword", "left").select("keyword", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"))


def wide_index(index: DataFrame) -> DataFrame:
    """``keyword, report_id, line_numbers``: the sorted lines of a keyword in one report."""
    return index.groupBy("keyword", "report_id").agg(F.sort_array(F.collect_set("line_number")).alias("line_numbers"))


def of_types(chunks: DataFrame, *types: str, column: str = "record_type") -> DataFrame:
    """Chunks of one of the types; a table partitioned by type reads only these."""
    return chunks.where(F.col(column).isin(*types))


def list_types(chunks: DataFrame, column: str = "record_type") -> DataFrame:
    """``record_type, n_chunks`` of every type there is."""
    return chunks.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("record_type")).agg(F.count("*").alias("n_chunks"))


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``token, key`` of the distinct tokens of each text: runs of letters, digits and underscores in lower case, of
    more than two characters, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    kept = F.filter(found, lambda t: (F.length(t) > SHORT) & ~t.isin(*STOP_WORDS))
    return docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.explode(kept).alias("token"), key).distinct()


def with_all(index: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """Keys that have every token; none for no tokens."""
    words = sorted({t.lower() for t in tokens})
    return index.where(F.col("token").isin(*words)).groupBy(key).agg(F.count_distinct("token").alias("_n")).where(F.col("_n") == len(words)).where(F.lit(bool(words))).select(key)


def with_any(index: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """Keys that have at least one of the tokens."""
    return index.where(F.col("token").isin(*[t.lower() for t in tokens])).select(key).distinct()
