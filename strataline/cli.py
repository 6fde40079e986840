"""Command line: ``build``, ``query``, ``analyze`` and ``interactive`` over text reports.

    python -m strataline.cli build  REPORTS OUT
    python -m strataline.cli query  OUT --pattern died --type keyword
    python -m strataline.cli analyze REPORTS OUT --pattern 'lost: \\d+' --type regex

REPORTS is a file, folder or glob of text files; OUT a folder for indexes and results.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.textnorm import query_pattern
from strataline.operators import catalog, context, index, query, sections
from strataline.operators.boundaries import MARKERS
from strataline.session import local_session, release
from strataline.sources.config import Config, ConfigError, load_indexes, load_queries, save_index
from strataline.sources.lines import read_text_lines


class CliError(Exception):
    """Ends the program with status 1."""


class IndexNotFound(CliError):
    """There is no index yet; says how to build it."""


class InvalidPattern(CliError):
    """A regular expression that doesn't compile."""


def build(spark: SparkSession, reports: str, out: str, config: Config | None = None, force: bool = False) -> bool:
    """Build lines, sections and keyword index of text reports; False if they are there already."""
    have = load_indexes(spark, out, ("lines", "sections", "keywords"))
    if all(v is not None for v in have.values()) and not force:
        return False
    numbered = read_text_lines(spark, reports).withColumn("report_id", F.xxhash64("file"))
    save_index(numbered.select("report_id", "file", "line_number", "content"), f"{out}/lines")
    lines = spark.read.parquet(f"{out}/lines")
    markers = config.markers if config and config.markers else MARKERS
    main = sections.detect_sections(lines, markers)
    patterns = config.subsections if config and config.subsections else catalog.dump_subsections()
    subs = sections.subsections(lines, patterns)
    save_index(sections.section_tree(sections.union_sections(main, subs), ("position",)), f"{out}/sections")
    save_index(index.keyword_index(lines, catalog.preset_keywords(config)), f"{out}/keywords")
    return True


def load(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    found = load_indexes(spark, out, ("lines", "sections", "keywords"))
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise IndexNotFound(f"no {', '.join(missing)} under {out}; run build first or pass --auto-build")
    return found


def run_queries(spark: SparkSession, out: str, queries: query.QuerySet, before: int, after: int, max_tokens: int, keep_history: bool = False, single: bool = False, files: str | None = None) -> list[dict]:
    """Run queries and write their pages under ``out/results``; the summary's rows.  A query without hits writes nothing.

    ``single``: all results of a query in one place, without pages; ``files``: a local folder for the files users open.
    """
    have = load(spark, out)
    for q in queries.queries.values():
        if q.type == "regex" and query_pattern(q.pattern) is None:
            raise InvalidPattern(f"{q.name}: {q.pattern!r} doesn't compile")
    root = f"{out}/results" + (f"/{time.strftime('%Y%m%d-%H%M%S')}" if keep_history else "/latest")
    hits = query.many(have["lines"], queries, have["sections"])
    paged = context.pages(hits, context.page_size(max_tokens, before, after))
    nested = context.nested_context(context.context_lines(have["lines"], hits, before, after))
    about = spark.createDataFrame([(q.name, q.type, q.pattern, q.priority, q.description) for q in queries.queries.values()], "query_name string, type string, pattern string, priority string, description string")
    results = context.result_rows(paged, about, before, after, max_tokens)
    written = (context.write_single if single else context.write_pages)(paged, nested, results, root)
    rows = [r.asDict(recursive=True) for r in written.orderBy("query_name").collect()] if "query_name" in written.columns else []
    if files and rows:
        context.export_files(spark, root, files, single)
    release(spark)
    return rows


def _queries(args) -> query.QuerySet:
    out = query.QuerySet()
    if args.config:
        for q in load_queries(args.config):
            x = query.Query.of(q)
            out.queries[x.name] = x
    elif args.pattern:
        out.register(args.name or f"query_{int(time.time())}", args.type, args.pattern, priority=args.priority, description=args.description)
    else:
        raise CliError("give --pattern or --config")
    return out


def _interactive(spark: SparkSession, out: str, ask=input) -> None:
    router_of = load(spark, out)
    router = query.Router(router_of["lines"], catalog.preset_keywords(), router_of["keywords"])
    while word := ask("keyword (empty to end): ").strip():
        router.query(word).orderBy("report_id", "line_number").show(20, truncate=120)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("reports")
    b.add_argument("out")
    b.add_argument("--force", action="store_true")
    b.add_argument("--markers", help="YAML configuration of markers, record types and keywords")
    for name in ("query", "analyze"):
        q = sub.add_parser(name)
        if name == "analyze":
            q.add_argument("reports")
        q.add_argument("out")
        q.add_argument("--name")
        q.add_argument("--config", help="JSON file of queries")
        q.add_argument("--pattern")
        q.add_argument("--type", choices=("keyword", "regex", "section"), default="keyword")
        q.add_argument("--priority", choices=catalog.PRIORITIES, default="MEDIUM")
        q.add_argument("--description", default="")
        q.add_argument("--context-before", type=int, default=context.DEFAULT_BEFORE)
        q.add_argument("--context-after", type=int, default=context.DEFAULT_AFTER)
        q.add_argument("--max-tokens", type=int, default=context.DEFAULT_TOKENS)
        q.add_argument("--keep-history", action="store_true")
        q.add_argument("--single-file", action="store_true", help="all results of a query together, without pages")
        q.add_argument("--files", metavar="FOLDER", help="write result.json, metadata.json and context/part_k.json there as well")
        q.add_argument("--markers")
        if name == "query":
            q.add_argument("--auto-build", metavar="REPORTS")
    i = sub.add_parser("interactive")
    i.add_argument("out")
    args = p.parse_args(argv)
    spark = spark or local_session("strataline")
    try:
        config = Config.load(args.markers) if getattr(args, "markers", None) else None
        if args.command == "build":
            print("built" if build(spark, args.reports, args.out, config, args.force) else "indexes are there; --force builds them again")
        elif args.command == "interactive":
            _interactive(spark, args.out)
        else:
            reports = args.reports if args.command == "analyze" else args.auto_build
            if reports:
                Path(args.out).mkdir(parents=True, exist_ok=True)
                build(spark, reports, args.out, config)
            for row in run_queries(spark, args.out, _queries(args), args.context_before, args.context_after, args.max_tokens, args.keep_history, args.single_file, args.files):
                print(f"{row['query_name']}: {row['total_results']} results in {row['total_parts']} pages")
    except (CliError, ConfigError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
