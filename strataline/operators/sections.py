"""Sections of reports: from boundary markers, from patterns, their tree, and the section of each line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataline.functions.textnorm import stripped
from strataline.operators.boundaries import MARKERS, boundaries
from strataline.session import CHUNK_LINES, small

SECTION_COLUMNS = ("report_id", "name", "start_line", "end_line", "section_type", "level", "priority", "category")


def section_name(content: Column, types: Column) -> Column:
    """Name of the section a marker line starts, null if it starts none."""
    line = stripped(content)
    dashed = F.nullif(F.regexp_extract(line, r"^-+\s+(.+?)\s+-+$", 1), F.lit(""))
    open_dash = F.nullif(F.regexp_extract(line, r"^-+\s+(.+?)(?:\s*\(.*\))?$", 1), F.lit(""))
    titled = F.nullif(F.regexp_extract(line, r"^=+\s+(.+?)\s+=+$", 1), F.lit(""))
    has = lambda t: F.array_contains(types, t)
    return F.when(has("equals_separator"), F.lit("HEADER")).when(has("dash_separator"), F.coalesce(dashed, open_dash)).when(has("equals_with_text"), titled)


def section_level(types: Column) -> Column:
    return F.when(F.exists(types, lambda t: t.startswith("equals")), 1).when(F.array_contains(types, "dash_separator"), 2).otherwise(1).cast("int")


def closed(starts: DataFrame, by: str = "report_id", last: Column | int = 0) -> DataFrame:
    """Starts with ``end_line``: the line before the next start of the source; ``last`` for the last one.

    A source's starts are ordered by a window: there are few to a report, and it streams.
    """
    order = Window.partitionBy(by).orderBy("start_line")
    end = last if isinstance(last, Column) else F.lit(last)
    return starts.withColumn("end_line", F.coalesce(F.lead("start_line").over(order) - 1, end.cast("bigint")))


def detect_sections(lines: DataFrame, markers=MARKERS) -> DataFrame:
    """``SECTION_COLUMNS`` of ``lines(report_id, line_number, content)``, one row a line at most.

    Duration lines start nothing; the last section of a report ends at 0, that is, with the report.
    """
    starts = boundaries(lines, markers).where(~F.exists("match_types", lambda t: F.contains(t, F.lit("duration_marker"))))
    named = starts.select(
        "report_id",
        section_name(F.col("content"), F.col("match_types")).alias("name"),
        F.col("line_number").alias("start_line"),
        F.element_at("match_types", 1).alias("section_type"),
        section_level(F.col("match_types")).alias("level"),
    ).where("name is not null")
    return closed(named).select("report_id", "name", "start_line", "end_line", "section_type", "level", F.lit("MEDIUM").alias("priority"), F.lit("unknown").alias("category"))


def _first_match(content: Column, patterns: list[dict]) -> Column:
    """The first pattern a line holds, as a struct; the line is put in lower case once for all of them."""
    kind = "struct<name:string,pattern:string,priority:string,category:string>"
    rows = [(p.get("name") or p["pattern"], p["pattern"], p.get("priority", "MEDIUM"), p.get("category", "unknown"), bool(p.get("whole"))) for p in patterns if p.get("pattern")]
    if not rows:
        return F.lit(None).cast(kind)
    every = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("name", "pattern", "priority", "category", "whole", "word"), (*r, r[1].lower()))]) for r in rows])
    held = F.flatten(F.transform(F.array(F.lower(content)), lambda low: F.filter(every, lambda p: F.contains(low, p["word"]))))
    ends = lambda p: F.regexp_like(content, F.concat(F.lit("(?iu)\\Q"), p["pattern"], F.lit("\\E(?!\\w|\\s+\\w)")))
    first = F.get(F.filter(held, lambda p: ~p["whole"] | ends(p)), 0)
    return F.when(first.isNotNull(), F.struct(*[first[k].alias(k) for k in ("name", "pattern", "priority", "category")])).cast(kind)


def subsections(lines: DataFrame, patterns: list[dict], first: int | None = None, last: int | None = None) -> DataFrame:
    """Level 3 sections where a line holds a pattern (case aside); of several patterns the first in the list counts.
    A pattern marked ``whole`` must not go on with a word.

    Of a range of lines, if given; the last one ends at ``last`` or at 0.
    """
    if first is not None or last is not None:
        lines = lines.where(F.col("line_number").between(first or 1, last if last is not None else (1 << 62)))
    hits = lines.withColumn("_m", _first_match(F.col("content"), patterns)).where("_m is not null")
    starts = hits.select("report_id", F.col("_m.name").alias("name"), F.col("line_number").alias("start_line"), F.lit("subsection").alias("section_type"), F.lit(3).alias("level"), F.col("_m.priority").alias("priority"), F.col("_m.category").alias("category"))
    return closed(starts, last=last or 0).select(*SECTION_COLUMNS)


def whole_file_subsections(lines: DataFrame, patterns: list[dict], open_end: int | None = None) -> DataFrame:
    """Subsections of whole reports: the last one ends with the report, or at ``open_end`` for what expects a large number there."""
    found = subsections(lines, patterns)
    if open_end is not None:
        return found.withColumn("end_line", F.when(F.col("end_line") == 0, F.lit(open_end).cast("bigint")).otherwise(F.col("end_line")))
    ended = found.join(small(report_ends(lines)), "report_id")
    return ended.withColumn("end_line", F.when(F.col("end_line") == 0, F.col("report_end")).otherwise(F.col("end_line"))).select(*SECTION_COLUMNS)


def report_ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy("report_id").agg(F.max("line_number").alias("report_end"))


def covering(lines: DataFrame, sections: DataFrame, size: int = CHUNK_LINES, ends: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``start_line`` (and the rest) of every section that covers them.

    Sections are laid over chunks of line numbers, so that the join is one on (report, chunk);
    no line meets a section of another chunk.  An end of 0 is the report's last line,
    that of ``ends(report_id, report_end)`` if ``lines`` are only some of the report's.
    """
    ends = report_ends(lines) if ends is None else ends
    chunk = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    laid = (
        sections.join(small(ends), "report_id")
        .withColumn("_end", F.when(F.coalesce("end_line", F.lit(0)) <= 0, F.col("report_end")).otherwise(F.least("end_line", "report_end")))
        .where("_end >= start_line")
        .withColumn("_chunk", F.explode(F.sequence(chunk(F.col("start_line")), chunk(F.col("_end")))))
        .drop("report_end")
    )
    return lines.withColumn("_chunk", chunk(F.col("line_number"))).join(small(laid), ["report_id", "_chunk"]).where("line_number between start_line and _end").drop("_chunk", "_end")


def subsections_in(lines: DataFrame, parents: DataFrame, patterns: dict[str, list[dict]]) -> DataFrame:
    """Subsections of each parent section, by the patterns of its name; the last of a parent ends with it.

    Adds ``pattern`` and ``parent_section``.  Lines may be repeated.
    """
    named = parents.where(F.col("name").isin(*patterns)).select("report_id", F.col("name").alias("parent_section"), "start_line", "end_line")
    inside = covering(lines.where(_first_match(F.col("content"), [p for v in patterns.values() for p in v]).isNotNull()), named, ends=report_ends(lines))
    ends = covering(lines.select("report_id", "line_number"), named).groupBy("report_id", "start_line").agg(F.max("line_number").alias("_parent_end"))
    found = F.coalesce(*[F.when(F.col("parent_section") == k, _first_match(F.col("content"), v)) for k, v in patterns.items()])
    hits = inside.withColumn("_m", found).where("_m is not null")
    starts = hits.select("report_id", F.col("start_line").alias("parent_start"), "parent_section", F.col("_m.name").alias("name"), F.col("_m.pattern").alias("pattern"), F.col("line_number").alias("start_line"), F.col("_m.priority").alias("priority"), F.col("_m.category").alias("category")).distinct()
    order = Window.partitionBy("report_id", "parent_start").orderBy("start_line")
    ended = starts.withColumn("_next", F.lead("start_line").over(order)).join(small(ends.withColumnRenamed("start_line", "parent_start")), ["report_id", "parent_start"])
    return ended.select("report_id", "parent_section", "parent_start", "name", "pattern", "start_line", F.coalesce(F.col("_next") - 1, F.col("_parent_end")).alias("end_line"), "priority", "category")


def union_sections(main: DataFrame, subs: DataFrame) -> DataFrame:
    """Main and subsections in one table with ``position``: by start line, main first where both start."""
    both = main.withColumn("_rank", F.lit(0)).unionByName(subs.withColumn("_rank", F.lit(1)))
    order = Window.partitionBy("report_id").orderBy("start_line", "_rank")
    return both.withColumn("position", F.row_number().over(order).cast("bigint")).drop("_rank")


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (report, position): the open sections are a stack of rising levels, so as deep as there are levels."""
    report, open_ = None, []
    for b in batches:
        out = []
        for rid, level, start in zip(*(b.column(c).to_pylist() for c in ("report_id", "level", "start_line"))):
            if rid != report:
                report, open_ = rid, []
            if level is None:
                out.append(None)
                continue
            while open_ and open_[-1][0] >= level:
                open_.pop()
            out.append(open_[-1][1] if open_ else None)
            open_.append((level, start))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "parent_start"])


def section_tree(sections: DataFrame, order_by: tuple[str, ...] = ("start_line",)) -> DataFrame:
    """``sections`` with ``parent_start``: the nearest earlier section of a smaller level, null at the top.

    Levels may be any numbers; a section of null level has no parent and is none.  Section starts, which are few to
    a report, stream by in order; only the open ones are held.
    """
    ordered = sections.repartition("report_id").sortWithinPartitions("report_id", *order_by)
    schema = StructType([*sections.schema.fields, StructField("parent_start", LongType())])
    return ordered.mapInArrow(_parents, schema)


def level_counts(sections: DataFrame) -> DataFrame:
    return sections.groupBy("level").agg(F.count("*").alias("n_sections"))
