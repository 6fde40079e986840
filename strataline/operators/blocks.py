"""Record blocks, chunks, their integrity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.textnorm import like_python
from strataline.operators.catalog import CHUNK_DEFAULT, CHUNK_LEAST, CHUNK_MOST, PRESERVED, RECORD_TYPES
from strataline.operators.sections import covering, report_ends
from strataline.session import CHUNK_LINES, small
from strataline.sources.lines import once, running_before

# Kind of block, priority, what opens it, what closes it (None: each line is its own block).
BLOCK_KINDS = (
    ("dumpsys", "HIGH", r"^--------- Differential dump.*?---------$", r"^------------------------------$"),
    ("logcat", "MEDIUM", r"^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+[A-Z]\s+\S+\s*:\s*.+$", None),
    ("anr", "CRITICAL", r"^----- pid \d+ at .+ -----$", r"^----- end .+ -----$"),
    ("tombstone", "CRITICAL", r"^\*\*\*( \*\*\*)+$", r"^--- --- --- --- --- --- ---"),
    ("property", "LOW", r"^\[.+?\]:\s*\[.*?\]", None),
    ("kernel", "MEDIUM", r"^\[\s*\d+\.\d+\]\s+.+$", None),
    ("stacktrace", "HIGH", r"^\s+at\s+[\w.$]+\(.*\)$", r"^\s+--- End of"),
)
#: Beginnings of lines that start a chapter; sizes in MB between the ways to chunk.
CHAPTER_MARKERS = ("================", "--- Bugreport", "--- System", "--- Kernel", "--- Main", "--- Events")
FINE_MB, RECORD_MB = 10, 100
LEAST_LINES, REPAIRABLE = 10, 10


def _carried(lines: DataFrame, flagged: Column, name: str, size: int = CHUNK_LINES) -> DataFrame:
    """``lines`` with ``name``: the latest flagged line number at or before each line; by chunks of line numbers."""
    chunked = lines.withColumn("_chunk", F.floor(F.col("line_number") / F.lit(size)).cast("bigint")).withColumn("_flag", F.when(flagged, F.col("line_number")))
    inside = Window.partitionBy("report_id", "_chunk").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("report_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunked.groupBy("report_id", "_chunk").agg(F.max("_flag").alias("_m")).select("report_id", "_chunk", F.max("_m").over(before).alias("_carry"))
    return chunked.withColumn("_in", F.max("_flag").over(inside)).join(small(carry), ["report_id", "_chunk"]).withColumn(name, F.coalesce("_in", "_carry")).drop("_chunk", "_flag", "_in", "_carry")


def record_blocks(lines: DataFrame, kinds=BLOCK_KINDS, unique: bool = True) -> DataFrame:
    """``report_id, type, start_line, end_line, priority``: a line that opens a block closes any open one on the line
    before; a line that closes the open block's kind is its last; the end of the report closes.  ``unique``: no line is repeated."""
    content = F.col("content")
    opens = F.coalesce(*[F.when(content.rlike(like_python(start)), F.lit(i)) for i, (_, _, start, _) in enumerate(kinds)])
    marked = lines.select("report_id", "line_number", opens.alias("_kind"), F.array_compact(F.array(*[F.when(content.rlike(like_python(end)), F.lit(i)) for i, (_, _, _, end) in enumerate(kinds) if end])).alias("_ends"))
    owned = _carried(once(marked, unique), F.col("_kind").isNotNull(), "start_line").where("start_line is not null")
    kind = F.max(F.when(F.col("line_number") == F.col("start_line"), F.col("_kind")))
    first_end = lambda i: F.min(F.when((F.col("line_number") > F.col("start_line")) & F.array_contains("_ends", i), F.col("line_number")))
    grouped = owned.groupBy("report_id", "start_line").agg(kind.alias("_kind"), F.max("line_number").alias("_last"), *[first_end(i).alias(f"_end{i}") for i, k in enumerate(kinds) if k[3]])
    end = F.col("_last")
    for i, k in enumerate(kinds):
        if k[3]:
            end = F.when((F.col("_kind") == i) & F.col(f"_end{i}").isNotNull(), F.col(f"_end{i}")).otherwise(end)
        else:
            end = F.when(F.col("_kind") == i, F.col("start_line")).otherwise(end)
    pick = lambda j: F.element_at(F.array(*[F.lit(k[j]) for k in kinds]), F.col("_kind") + 1)
    return grouped.select("report_id", pick(0).alias("type"), "start_line", end.alias("end_line"), pick(1).alias("priority"))


def _marked(pattern: str) -> bool:
    """Whether all that a pattern matches surely begins with one of ``= - # *``."""
    if re.search(r"\\[()|]|\[[^\]]*[()|]", pattern):  # parentheses that aren't groups
        return False
    branches = re.sub(r"\([^()]*\)", "()", pattern).split("|")
    return all(re.match(r"\^(?:[=\-#]|\\\*)(?![?*]|\{0|\{,)", b) for b in branches)


def record_types(lines: DataFrame, patterns=RECORD_TYPES, unique: bool = True) -> DataFrame:
    """``report_id, record_type, priority, category, start_line, end_line`` by start and end patterns, which are matched from
    the start of a line: a record ends at the first line after its start that matches its end, or with the report.

    Marks stream by in descending order, so a report with many is no more than sorted.  ``unique``: no line is repeated.
    """
    content = F.col("content")
    begins = F.substring(content, 1, 1).isin("=", "-", "#", "*")
    whole = lambda p: content.rlike(like_python(f"^(?:{p})"))
    found = lambda p: begins & whole(p) if _marked(p) else whole(p)
    side = lambda j: F.array_compact(F.array(*[F.when(found(r[j]), F.lit(r[0])) for r in patterns]))
    # where every pattern begins like a marker, the other lines never reach them
    tried = lines.where(begins) if all(_marked(p) for r in patterns for p in r[3:5]) else lines
    marks = tried.select("report_id", "line_number", side(3).alias("starts"), side(4).alias("ends"))
    held = marks.where((F.size("starts") > 0) | (F.size("ends") > 0))
    each = once(held, unique).select("report_id", "line_number", "starts", "ends", F.explode(F.array_union("starts", "ends")).alias("record_type"))
    is_end = F.array_contains("ends", F.col("record_type"))
    later = Window.partitionBy("report_id", "record_type").orderBy(F.desc("line_number")).rangeBetween(Window.unboundedPreceding, -1)
    both = each.withColumn("end_line", F.min(F.when(is_end, F.col("line_number"))).over(later)).where(F.array_contains("starts", F.col("record_type")))
    pick = lambda j: F.element_at(F.create_map(*[F.lit(x) for r in patterns for x in (r[0], r[j])]), F.col("record_type"))
    return both.join(small(report_ends(lines)), "report_id").select(
        "report_id", "record_type", pick(1).alias("priority"), pick(2).alias("category"), F.col("line_number").alias("start_line"), F.coalesce("end_line", "report_end").alias("end_line")
    )


def strategy(size_mb: Column) -> Column:
    """How a report of so many MB is chunked."""
    return F.when(size_mb < FINE_MB, "fine").when(size_mb < RECORD_MB, "record").otherwise("chapter")


def chapter_chunks(lines: DataFrame, markers=CHAPTER_MARKERS, unique: bool = True) -> DataFrame:
    """``report_id, start_line, end_line, n_lines, n_bytes, chapter``: a chunk starts at each line that begins like a chapter;
    what goes before the first is ``header``.  ``unique``: no line is repeated."""
    begins = F.lit(False)
    trimmed = F.ltrim("content")
    for m in markers:
        begins = begins | trimmed.startswith(m)
    sized = lines.select("report_id", "line_number", begins.alias("_begins"), F.octet_length("content").alias("_size"), F.when(begins, F.trim("content")).alias("_title"))
    owned = _carried(once(sized, unique), F.col("_begins"), "_start")
    return owned.groupBy("report_id", F.coalesce("_start", F.lit(0)).alias("_start")).agg(
        F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.count("*").alias("n_lines"), F.sum("_size").alias("n_bytes"),
        F.when(F.max("_start").isNull(), "header").otherwise(F.max("_title")).alias("chapter"),
    ).drop("_start")


def fine_chunks(blocks: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """Record blocks of at least ``least`` lines; shorter ones are left out."""
    return blocks.where(F.col("end_line") - F.col("start_line") + 1 >= least)


def record_chunks(lines: DataFrame, most: int, unique: bool = True) -> DataFrame:
    """``report_id, chunk_no, start_line, end_line, n_bytes, byte_offset``: a report in buckets of ``most`` bytes by running size.

    A line goes to the bucket its first byte falls in, so every bucket but those around a longer line has
    between ``most`` less one line and ``most`` plus one line of bytes.  Buckets by running sums need no
    sequential pass over a report.
    """
    sized = once(lines.select("report_id", "line_number", (F.octet_length("content") + 1).cast("bigint").alias("_size")), unique)
    placed = running_before(sized, "_size")
    grouped = placed.groupBy("report_id", F.floor(F.col("before") / F.lit(most)).cast("bigint").alias("chunk_no"))
    return grouped.agg(F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.sum("_size").alias("n_bytes"), F.min("before").alias("byte_offset"))


def section_chunks(lines: DataFrame, records: DataFrame, default: int = CHUNK_DEFAULT, least: int = CHUNK_LEAST, most: int = CHUNK_MOST, preserved=PRESERVED, unique: bool = True) -> DataFrame:
    """``report_id, record_type, record_start, start_line, end_line, n_bytes``: records (``report_id, record_type, start_line,
    end_line``) in chunks: whole if their type is preserved or they have at most ``most`` bytes, else in buckets of ``default``
    bytes of the report's running size; a bucket of fewer than ``least`` bytes goes with the one before it in its record.
    """
    sized = once(lines.select("report_id", "line_number", (F.octet_length("content") + 1).cast("bigint").alias("_size")), unique)
    key = ["report_id", "record_type", "record_start"]
    named = records.select("report_id", "record_type", F.col("start_line").alias("record_start"), "start_line", "end_line").distinct()
    inside = covering(running_before(sized, "_size"), named)
    buckets = inside.groupBy(*key, F.floor(F.col("before") / F.lit(default)).alias("_bucket")).agg(
        F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.sum("_size").alias("n_bytes")
    )
    order = Window.partitionBy(*key).orderBy("_bucket")
    whole = F.col("record_type").isin(*preserved) | (F.sum("n_bytes").over(Window.partitionBy(*key)) <= most)
    begins = F.when((F.row_number().over(order) == 1) | (~whole & (F.col("n_bytes") >= least)), 1).otherwise(0)
    numbered = buckets.withColumn("_begins", begins).withColumn("_chunk", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_chunk").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("n_bytes").alias("n_bytes")).drop("_chunk")


def checksums(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.md5(text).alias("md5"), F.sha2(text, 256).alias("sha256"))


def verify(df: DataFrame, text: str, checksum: str) -> DataFrame:
    """Rows whose text doesn't have the checksum (MD5)."""
    return df.where(~F.md5(text).eqNullSafe(F.col(checksum)))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges ``report_id, start_line, end_line`` that begin at or before the furthest end of an earlier one."""
    before = Window.partitionBy("report_id").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_reach", F.max("end_line").over(before)).where("_reach >= start_line").select("report_id", "start_line", "end_line", F.col("_reach").alias("reached"))


def gaps(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """``report_id, gap_start, gap_end``: lines from 1 to the report's end that no range covers."""
    order = Window.partitionBy("report_id").orderBy("start_line", "end_line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    closing = ends.select("report_id", (F.col("report_end") + 1).alias("start_line"), (F.col("report_end") + 1).alias("end_line"))
    every = ranges.select("report_id", "start_line", "end_line").unionByName(closing).withColumn("_reach", F.coalesce(F.max("end_line").over(before), F.lit(0)))
    return every.where("start_line > _reach + 1").select("report_id", (F.col("_reach") + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end"))


def repaired(ranges: DataFrame, most: int = REPAIRABLE) -> DataFrame:
    """Ranges joined where between 1 and ``most`` less one lines lie between a range and the one before."""
    order = Window.partitionBy("report_id").orderBy("start_line")
    between = F.col("start_line") - F.lag("end_line").over(order) - 1
    islands = ranges.withColumn("_new", F.when((between > 0) & (between < most), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("report_id", "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n_joined")).drop("_island")


def complete(kind: Column, content: Column) -> Column:
    """Whether a record of a kind is whole."""
    return (
        F.when(kind == "anr", F.contains(content, F.lit("----- pid")) & F.contains(content, F.lit("----- end")))
        .when(kind == "tombstone", F.contains(content, F.lit("*** *** ***")))
        .when(kind == "logcat", content.rlike(r"^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"))
        .otherwise(F.lit(True))
    )


def block_contents(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks with ``content_lines array<string>``, in order; a block is as long as its record is."""
    inside = covering(lines, blocks)
    return inside.groupBy("report_id", "type", "start_line", "end_line", "priority").agg(F.sort_array(F.collect_list(F.struct("line_number", "content"))).alias("_l")).withColumn("content_lines", F.col("_l.content")).drop("_l")


def store_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", codec: str = "zstd") -> None:
    """Write chunks as parquet or JSON lines, partitioned by record type where there is one."""
    parts = [c for c in ("record_type", "type") if c in chunks.columns][:1]
    chunks.write.mode("overwrite").format({"jsonl": "json"}.get(fmt, fmt)).option("compression", codec).partitionBy(*parts).save(path)


def read_chunks(spark, path: str, fmt: str = "parquet", ids: list | None = None, types: list[str] | None = None, times: tuple[str, str] | None = None, id_range: tuple[int, int] | None = None, key: str = "chunk_id") -> DataFrame:
    """Stored chunks by id, by record type, by time (column ``ts``) and by range of ids, both ends included; all for none.
    Types are folders, and what else is asked reaches the files' own statistics."""
    out = spark.read.format({"jsonl": "json"}.get(fmt, fmt)).load(path)
    if types is not None:
        out = out.where(F.col("record_type").isin(*types))
    if ids is not None:
        out = out.where(F.col(key).isin(*ids))
    if id_range is not None:
        out = out.where(F.col(key).between(*id_range))
    if times is not None:
        out = out.where(F.col("ts").between(*(F.lit(t).cast("timestamp_ntz") for t in times)))
    return out
