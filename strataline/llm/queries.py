"""Queries of the training-data problems for language models: 2, 5, 6, 7 and 8."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.layouts import LEVELS
from strataline.llm.leaks import leaks
from strataline.llm.runs import event_runs
from strataline.llm.splitting import split_sections
from strataline.llm.subjects import document_subjects
from strataline.llm.tokens import token_ids
from strataline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(*(table(spark, sf_dir, t) for t in ("query_results", "sections", "custom_queries")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(table(spark, sf_dir, "query_results")).select("report_id", "first_line", "last_line", "n_events")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with level, component, first and last time and duration."""
    runs = event_runs(table(spark, sf_dir, "query_results"), table(spark, sf_dir, "reports"))
    names = F.array(*map(F.lit, LEVELS))
    return runs.select(
        "report_id", "first_line", "last_line", "n_events", F.element_at(names, F.col("level_id")).alias("log_level"), "component", "first_micros", "last_micros",
        (F.col("last_micros") - F.col("first_micros")).alias("duration_micros"),
    )


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary: in STRATALINE_TOKENIZERS if that is set, else where the package of public tokenizers is."""
    if where := os.environ.get("STRATALINE_TOKENIZERS"):
        return os.path.join(where, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), vocabulary())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item that leaked, and in how many documents."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels")).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject."""
    return p8_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p5_runs, p6_ids, p7_found, p7_items, p8_found, p8_composition)}
ORACLES: dict[str, str] = {}
