"""Oversized sections cut into line ranges under a limit (problem 2).

Where a piece ends depends on where the one before ended (each ends at the *furthest* boundary within the limit), so cutting
near the middle first, as recursive bisection does, can't give the required pieces by itself.  What can be bisected is the
work: running sizes of a report are halved again and again down to parts of equal size, and a part answers for every line at
which a piece could begin in it where the first piece beyond it begins.  These answers are step functions, a few steps
each, since pieces that begin at different lines soon end at the same boundary.  They are composed in order, a row for each
part, which tells the line each part is entered at; then all parts are cut at once.

1. `packed`: every line is measured (size, whether it opens an entry, is a marker, is blank); lines are packed to one row
   for ``PACK`` line numbers before anything is shuffled by section.
2. `windows`: the packs under a section are laid over parts; a part also gets the lines of its neighbours that lie within one
   limit of it, which is all that a piece that begins in it can reach.
3. `_solve`: the pieces of each part if it is entered at its first line, as the first part of every section is, and its
   step function.
4. `_follow`: composition, for sections of several parts; `_finish`: the pieces of parts entered elsewhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from strataline.functions import layouts as L
from strataline.operators.boundaries import is_marker
from strataline.operators.matching import containing
from strataline.operators.parsing import Rules, broadcast_rules, text_lines
from strataline.session import materialize, small

#: Lines in a packed row.
PACK = 512
#: Tokens of a query that names no limit.
DEFAULT_LIMIT = 32_000
#: Tokens of a part, and limits it spans at least.
PART_TOKENS, PART_LIMITS = 1 << 18, 8
OPENS, MARKER, BLANK = 1, 2, 4
#: In place of the number of a line: the next one there is.  The lines a part has end at one beyond the limit, however far the next is.
NEXT = -1
KEYS = ("report_id", "start_line", "part")


def _measure(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(known.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            size = np.fromiter(((len(x) + 3) // 4 for x in texts), np.int64, len(texts))
            flags = np.zeros(len(texts), np.int8)
            for i, x in enumerate(texts):
                rule = rules[L.head(x)]
                f = OPENS if rule >= 0 and L.extract(rule, x).kind in (L.START, L.JUL, L.JOPEN) else 0
                s = x.strip()
                if not s:
                    f |= BLANK
                elif s[0] in "=-*#[" and is_marker(s):
                    f |= MARKER
                flags[i] = f
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(flags)], ["report_id", "line_number", "size", "flags"])

    return run


def measured(lines: DataFrame) -> DataFrame:
    """``report_id, line_number, size, flags`` of lines with content."""
    return text_lines(lines).mapInArrow(_measure(broadcast_rules(lines)), "report_id bigint, line_number bigint, size bigint, flags tinyint")


def packed(lines: DataFrame) -> DataFrame:
    """One row per report and ``PACK`` line numbers: ``report_id, pack, lines array<struct<n, size, flags>>``, sorted, each line once."""
    row = F.struct(F.col("line_number").alias("n"), "size", "flags")
    return (
        measured(lines)
        .groupBy("report_id", F.floor(F.col("line_number") / F.lit(PACK)).cast("bigint").alias("pack"))
        .agg(F.sort_array(F.collect_set(row)).alias("lines"))
    )


def placed(packs: DataFrame) -> DataFrame:
    """``report_id, pack, before, after, after_blank``: size of the report's lines before and up to the end of each pack, and
    whether the line before it is blank; over one row a pack."""
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["size"])
    ends_blank = F.element_at("lines", -1)["flags"].bitwiseAND(BLANK) > 0
    order = Window.partitionBy("report_id").orderBy("pack")
    summary = packs.select("report_id", "pack", total.alias("_size"), ends_blank.alias("_blank"))
    upto = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return summary.select("report_id", "pack", (upto - F.col("_size")).alias("before"), upto.alias("after"), F.coalesce(F.lag("_blank").over(order), F.lit(False)).alias("after_blank"))


class Stretch:
    """Lines in order, with what is needed to find where a piece that begins at any of them ends."""

    def __init__(self, n: np.ndarray, size: np.ndarray, natural: np.ndarray, before: int):
        self.n, self.total = n, len(n)
        self.sums = before + np.concatenate([[0], np.cumsum(size)])  # sums[i]: size of the lines before i
        self.last_natural = np.maximum.accumulate(np.where(natural, np.arange(len(n)), -1))

    def advance(self, cut: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
        """For pieces that follow a cut in front of the lines ``cut``: the first line of each, and the line in front of which
        it is cut; ``total`` if all that is left fits, ``total + 1`` if a line beyond the limit is the last of these.

        Where the overlap alone fills a piece, it is shortened until one new line fits.
        """
        sums, total = self.sums, self.total
        start = np.maximum(cut - overlap, 0)
        end = np.searchsorted(sums, sums[start] + limit, "right") - 1  # first line beyond the limit
        full = end <= cut
        if full.any():
            least = np.minimum(np.searchsorted(sums, sums[cut + 1] - limit, "left"), cut)
            start = np.where(full, least, start)
            end = np.where(full, np.maximum(np.searchsorted(sums, sums[start] + limit, "right") - 1, cut + 1), end)
        natural = self.last_natural[np.minimum(end, total - 1)]
        beyond = np.where(sums[total] <= sums[start] + limit, total, total + 1)
        return start, np.where(end >= total, beyond, np.where(natural > cut, natural, end))


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs under a section laid over parts: for each part the lines of a pack that the part needs."""
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in ("report_id", "start_line", "end_line", "pack", "jobs", "before", "after_blank", "limit", "part_tokens")}
        lists = b.column("lines")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        ns, sizes, flags = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        rows, kept = [], []
        for i in range(b.num_rows):
            a, z = offsets[i], offsets[i + 1]
            n, size, f = ns[a:z], sizes[a:z], flags[a:z]
            blank = (f & BLANK) > 0
            natural = ((f & (OPENS | MARKER)) > 0) | (np.r_[cols["after_blank"][i], blank[:-1]] & ~blank)
            sums = cols["before"][i] + np.concatenate([[0], np.cumsum(size)])
            lo, hi = np.searchsorted(n, [cols["start_line"][i], cols["end_line"][i] + 1])
            if lo == hi:
                continue
            width, limit = cols["part_tokens"][i], cols["limit"][i]
            own = sums[lo:hi] // width
            # parts with lines here, and their neighbours as far as a limit reaches
            parts = np.unique(np.concatenate([own, (sums[lo:hi] - limit) // width, (sums[lo:hi] + limit) // width]))
            for t in parts[parts >= 0].tolist():
                x, y = np.searchsorted(sums[lo:hi], [t * width - limit, (t + 1) * width + limit], "left") + lo
                if x < y:
                    rows.append((cols["report_id"][i], cols["start_line"][i], t, cols["pack"][i], cols["jobs"][i], width, int(sums[x])))
                    kept.append((a + x, a + y, natural[x:y]))
        if not rows:
            continue
        index = np.concatenate([np.arange(x, y) for x, y, _ in kept])
        ends = np.concatenate([[0], np.cumsum([y - x for x, y, _ in kept])]).astype(np.int32)
        cells = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(zip(*rows), types)), cells(ns[index]), cells(sizes[index]), cells(np.concatenate([x for *_, x in kept]))],
            ["report_id", "start_line", "part", "pack", "jobs", "part_tokens", "before", "n", "size", "natural"],
        )


_WINDOWS = "report_id bigint, start_line bigint, part bigint, pack bigint, jobs array<int>, part_tokens bigint, before bigint, n array<bigint>, size array<bigint>, natural array<boolean>"


class Part(NamedTuple):
    """The lines of one part of a section, with those of its neighbours that it needs; its own are ``first`` up to ``last``."""

    key: tuple[int, int, int]
    todo: list
    lines: Stretch
    first: int
    last: int
    begins: int

    def orbit(self, entry: int, limit: int, overlap: int) -> tuple[list[int], list[int], int | None]:
        """Pieces that begin in the part if it is entered at ``entry``: numbers of the first and last line of each, and of the
        line the part is left at, as `_line` has it."""
        n, total = self.lines.n, self.lines.total
        firsts, lasts, cut = [], [], entry
        while cut < self.last:
            start, end = self.lines.advance(np.array([cut]), limit, overlap)
            cut = int(end[0])
            firsts.append(int(n[start[0]]))
            lasts.append(int(n[min(cut, total) - 1]))
        return firsts, lasts, self._line(cut)

    def _line(self, cut: int) -> int | None:
        """Number of a line; None behind the end of the section, NEXT for whatever line comes next in it."""
        return int(self.lines.n[cut]) if cut < self.lines.total else None if cut == self.lines.total else NEXT

    def steps(self, limit: int, overlap: int) -> tuple[list[int], list[int | None]]:
        """Step function of the part: line numbers from which on it is left at another line, and these lines.

        A part is entered within a limit of where it begins, or behind a line that is larger than the limit.
        """
        n, sums = self.lines.n, self.lines.sums
        own = np.arange(self.first, self.last)
        behind = np.r_[True, np.diff(sums)[:-1] > limit][own]
        entries = own[(sums[own] <= self.begins + limit) | behind | (own == self.first)]
        at = entries.copy()
        while (inside := at < self.last).any():
            distinct, where = np.unique(at[inside], return_inverse=True)
            at[inside] = self.lines.advance(distinct, limit, overlap)[1][where]
        keep = np.r_[True, at[1:] != at[:-1]]
        return n[entries[keep]].tolist(), [self._line(k) for k in at[keep].tolist()]


def _parts(batches: Iterator[pa.RecordBatch], todo: str) -> Iterator[Part]:
    """Whole parts from rows in order of (report, section, part, pack); column ``todo`` says what is to be done."""
    key, held = None, []

    def whole() -> Iterator[Part]:
        if not held:
            return
        job, before, width, *_ = held[0]
        lines = Stretch(*(np.concatenate([h[k] for h in held]) for k in (3, 4, 5)), before)
        begins = key[2] * width
        first, last = (int(x) for x in np.searchsorted(lines.sums[:-1], [begins, begins + width], "left"))
        if first < last:
            yield Part(key, job, lines, first, last, begins)

    for b in batches:
        meta = zip(*(b.column(c).to_pylist() for c in (*KEYS, todo, "before", "part_tokens")))
        arrays = []
        for c in ("n", "size", "natural"):
            lists = b.column(c)
            offsets = lists.offsets.to_numpy()
            arrays.append((lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]))
        for i, (*of, job, before, width) in enumerate(meta):
            if tuple(of) != key:
                yield from whole()
                key, held = tuple(of), []
            held.append((job, before, width, *(v[o[i] : o[i + 1]] for v, o in arrays)))
    yield from whole()


_SOLVED = pa.schema(
    [*((k, pa.int64()) for k in KEYS), ("job", pa.int32()), ("first_own", pa.int64()), ("last_own", pa.int64()), ("left_at", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("firsts", "lasts", "entries", "exits")]
)


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _solve(shared):
    """Pieces of each part entered at its first line, and its step function."""
    queries = shared.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in _parts(batches, "jobs"):
            n = part.lines.n
            for job in part.todo:
                _, limit, overlap = queries[job]
                firsts, lasts, left = part.orbit(part.first, limit, overlap)
                # what no piece can pass has no step function to ask
                entries, exits = part.steps(limit, overlap) if part.first > 0 or part.last < part.lines.total else ([], [])
                rows.append((*part.key, job, int(n[part.first]), int(n[part.last - 1]), left, firsts, lasts, entries, exits))
            if len(rows) > 2_000:
                yield _rows(rows, _SOLVED)
                rows = []
        yield _rows(rows, _SOLVED)

    return run


_FOLLOWED = pa.schema([*((k, pa.int64()) for k in KEYS), ("job", pa.int32()), ("entry", pa.int64()), ("firsts", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64()))])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (section, query, part): the line each part is entered at, with its pieces where they are known."""
    key, entry = None, None
    for b in batches:
        rows = []
        for report, start, part, job, first, last, left, firsts, lasts, entries, exits in zip(*(b.column(c).to_pylist() for c in _SOLVED.names)):
            if (report, start, job) != key:
                key, entry = (report, start, job), first
                if left is None and len(firsts) == 1:  # the section is within the limit
                    entry = None
            if entry == NEXT:
                entry = first
            if entry is None or entry > last:
                continue
            if entry == first:
                rows.append((report, start, part, job, entry, firsts, lasts))
                entry = left
            else:
                rows.append((report, start, part, job, entry, None, None))
                entry = exits[bisect_right(entries, entry) - 1]
        yield _rows(rows, _FOLLOWED)


_PIECES = pa.schema([("query_name", pa.string()), ("report_id", pa.int64()), ("section_start", pa.int64()), ("piece_start", pa.int64()), ("piece_end", pa.int64())])


def _finish(shared):
    """Pieces of parts that are entered behind their first line."""
    queries = shared.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "asked"):
            rows = []
            for ask in part.todo:
                name, limit, overlap = queries[ask["job"]]
                firsts, lasts, _ = part.orbit(int(np.searchsorted(part.lines.n, ask["entry"])), limit, overlap)
                rows += [(name, *part.key[:2], *p) for p in zip(firsts, lasts)]
            yield _rows(rows, _PIECES)

    return run


def section_queries(queries: DataFrame) -> list[tuple[str, str, int, int]]:
    """Name, pattern, limit and overlap of the enabled queries of type section with a pattern; defaults in place of nulls.
    The queries are a stated set, held by the driver."""
    asked = queries.where("enabled and lower(trim(type)) = 'section' and pattern is not null and pattern <> '' and name is not null")
    rows = asked.select("name", "pattern", F.col("max_tokens_per_file").cast("bigint").alias("limit"), F.col("overlap_lines").cast("bigint").alias("overlap"))
    return [(r.name, r.pattern, DEFAULT_LIMIT if r.limit is None else r.limit, max(0, r.overlap or 0)) for r in rows.toLocalIterator()]


def latest_sections(sections: DataFrame) -> DataFrame:
    """``report_id, start_line, section_name, end_line``: of repeated sections the latest."""
    return (
        sections.where("report_id is not null and start_line is not null and name is not null")
        .groupBy(F.col("report_id").cast("bigint").alias("report_id"), F.col("start_line").cast("bigint").alias("start_line"))
        .agg(F.max(F.struct("ingested_at", "name", F.col("end_line").cast("bigint").alias("end_line"))).alias("s"))
        .select("report_id", "start_line", F.col("s.name").alias("section_name"), F.col("s.end_line").alias("end_line"))
    )


def split_sections(lines: DataFrame, sections: DataFrame, queries: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``query_name, report_id, section_start, piece_start, piece_end`` of the pieces of every section that is larger
    than the limit of a query selecting it.

    A section's key is (report, start line); of repeated rows the latest counts; an end of 0 or null
    is the report's last line.  A null limit is 32,000 tokens, a null overlap 0 lines.  Where the
    overlap would fill a whole piece it is shortened until one new line fits; a single line beyond
    the limit is a piece of its own.  Blank lines cost nothing.  Sections without name, empty tables and
    lines without content give no rows; extra columns are ignored.  ``part_tokens`` says how finely the work is halved
    and changes no result.
    """
    spark = lines.sparkSession
    asked = section_queries(queries)
    if not asked:
        return spark.createDataFrame([], "query_name string, report_id bigint, section_start bigint, piece_start bigint, piece_end bigint")
    shared = spark.sparkContext.broadcast([(name, limit, overlap) for name, _, limit, overlap in asked])
    limits = spark.createDataFrame([(i, q[2]) for i, q in enumerate(asked)], "job int, tokens bigint")
    jobs = (
        containing(latest_sections(sections), "section_name", [q[1] for q in asked], "found")
        .select("report_id", "start_line", "end_line", F.explode("found").alias("job"))
        .join(small(limits), "job")
        .groupBy("report_id", "start_line")
        .agg(F.max("end_line").alias("end_line"), F.sort_array(F.collect_list("job")).alias("jobs"), F.max("tokens").alias("limit"))
        .withColumn("part_tokens", F.greatest(F.lit(part_tokens), F.lit(PART_LIMITS) * F.col("limit")))
    )
    packs = materialize(packed(lines), "packs")
    ends = packs.groupBy("report_id").agg(F.max(F.element_at("lines", -1)["n"]).alias("report_end"))
    pack = lambda c: F.floor(F.col(c) / F.lit(PACK)).cast("bigint")
    bounded = (
        jobs.join(small(ends), "report_id")
        .withColumn("end_line", F.when(F.coalesce("end_line", F.lit(0)) <= 0, F.col("report_end")).otherwise(F.least("end_line", "report_end")))
        .where("end_line >= start_line")
        .withColumn("pack", F.explode(F.sequence(pack("start_line"), pack("end_line"))))
        .drop("report_end")
    )

    def windows(of: DataFrame) -> DataFrame:
        under = of.join(placed(packs), ["report_id", "pack"]).join(packs, ["report_id", "pack"])
        return under.mapInArrow(_slice, _WINDOWS)

    def in_order(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys[:3]).sortWithinPartitions(*keys)

    solved = in_order(windows(bounded), *KEYS, "pack").mapInArrow(_solve(shared), from_arrow_schema(_SOLVED))
    followed = materialize(in_order(solved, "report_id", "start_line", "job", "part").mapInArrow(_follow, from_arrow_schema(_FOLLOWED)), "followed")
    names = F.array(*[F.lit(q[0]) for q in asked])
    piece = followed.where("firsts is not null").select(F.get(names, F.col("job")).alias("query_name"), "report_id", F.col("start_line").alias("section_start"), F.explode(F.arrays_zip("firsts", "lasts")).alias("p"))
    known = piece.select("query_name", "report_id", "section_start", F.col("p.firsts").alias("piece_start"), F.col("p.lasts").alias("piece_end"))
    open_ = followed.where("firsts is null")
    if open_.isEmpty():  # no section has several parts
        return known
    asks = open_.groupBy(*KEYS).agg(F.collect_list(F.struct("job", "entry")).alias("asked"))
    again = windows(bounded.join(small(open_.select("report_id", "start_line").distinct()), ["report_id", "start_line"], "left_semi"))
    rest = in_order(again.join(small(asks), list(KEYS)), *KEYS, "pack").mapInArrow(_finish(shared), from_arrow_schema(_PIECES))
    return known.unionByName(rest)
