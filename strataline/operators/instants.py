"""One UTC instant for every line that states its time (problem 1).

All valid interpretations of each stated time are generated as arrays; which holds is
chosen by Viterbi over the record order of the source (the report), with a price on
changing the order of day and month and on jumps backward in time.

A source may be of any length: it is cut into chunks of line numbers.  Each chunk of a
source that has several gives the least cost from each state of its first record to each
of its last (a 2 x 2 matrix); these rows, one for thousands of lines, are joined in order
for each source, which fixes the states at both ends of every chunk; then all chunks
trace their own paths.  The result is the same as of one pass over the whole source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import clocks as C
from strataline.operators.entries import with_chunk
from strataline.operators.parsing import parse_lines
from strataline.session import CHUNK_LINES, materialize, small


def _readings(batches):
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(2, b.num_columns)]
        at, orders, keep = [], [], []
        for i, row in enumerate(zip(*cols)):
            a, o = C.readings(*row)
            if a:
                at.append(a)
                orders.append(o)
                keep.append(i)
        index = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(index), b.column(1).take(index), pa.array(at, pa.list_(pa.int64())), pa.array(orders, pa.list_(pa.int8()))],
            ["report_id", "line_number", "readings", "orders"],
        )


def candidates(parsed: DataFrame, reports: DataFrame) -> DataFrame:
    """``report_id, line_number, readings array<bigint>, orders array<tinyint>`` of every parsed line that states a time it
    has at least one valid interpretation of."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    about = reports.where("report_id is not null").groupBy("report_id").agg(
        F.max("tz_name").alias("tz_name"), F.max(micros("boot_at")).alias("boot"), F.max(micros("captured_at")).alias("captured")
    )
    stated = parsed.where("clock > 0").select("report_id", "line_number", "clock", "micros", "swapped", "zone_offset", "zone_abbr")
    joined = stated.join(small(about), "report_id", "left")
    return joined.mapInArrow(_readings, "report_id bigint, line_number bigint, readings array<bigint>, orders array<tinyint>")


#: In place of an instant: the state isn't valid.
_NONE = np.iinfo(np.int64).min


def _records(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers of a chunk in record order, without repeated lines; instants by state, ``_NONE`` where it isn't valid; and the
    same as numbers for the costs, NaN there.  State 0: day and month as written, 1: exchanged."""
    g = group.combine_chunks()
    numbers, at, orders = g.column("line_number").to_numpy(), *(g.column(c).chunk(0) for c in ("readings", "orders"))
    row = np.repeat(np.arange(len(numbers)), np.diff(at.offsets.to_numpy()))
    values, state = at.flatten().to_numpy(), orders.flatten().to_numpy()
    states = np.full((len(numbers), 2), _NONE)
    sure = state < 0
    states[row[sure]] = values[sure, None]
    states[row[~sure], state[~sure]] = values[~sure]
    order = np.argsort(numbers, kind="stable")
    order = order[np.r_[True, np.diff(numbers[order]) != 0]]
    return numbers[order], states[order], _as_costs(states[order])


def _as_costs(states: np.ndarray) -> np.ndarray:
    t = states.astype(float)
    t[states == _NONE] = np.nan
    return t


def _summarise(key, group):
    _, states, t = _records(group)
    row = [key[0].as_py(), key[1].as_py(), states[0].tolist(), states[-1].tolist(), sum(C.matrix(t), [])]
    return pa.Table.from_arrays([pa.array([x], k.type) for x, k in zip(row, _SUMMARY_SCHEMA)], schema=_SUMMARY_SCHEMA)


_SUMMARY = "report_id bigint, chunk bigint, first_at array<bigint>, last_at array<bigint>, cost array<double>"
_SUMMARY_SCHEMA = pa.schema([("report_id", pa.int64()), ("chunk", pa.int64()), ("first_at", pa.list_(pa.int64())), ("last_at", pa.list_(pa.int64())), ("cost", pa.list_(pa.float64()))])


def _join_chunks(key, group):
    """States at both ends of each chunk of one source."""
    g = group.sort_by("chunk").to_pylist()
    # records first, last, first, last ...; inside a chunk the matrix is the cost of the step
    t = _as_costs(np.array([x for r in g for x in (r["first_at"], r["last_at"])]))
    cost = C.steps(t)
    for i, r in enumerate(g):
        cost[2 * i] = np.minimum(np.array(r["cost"]).reshape(2, 2), C.NEVER)
    ends, back = C.best(cost, C.entry_cost(t))
    path = C.trace(back, 0 if ends[0] <= ends[1] else 1)
    return pa.table({"report_id": [r["report_id"] for r in g], "chunk": [r["chunk"] for r in g], "first": path[::2], "last": path[1::2]}, schema=_ENDS_SCHEMA)


_ENDS = "report_id bigint, chunk bigint, first int, last int"
_ENDS_SCHEMA = pa.schema([("report_id", pa.int64()), ("chunk", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _choose(key, group):
    numbers, states, t = _records(group)
    chosen = np.where(states[:, 0] == _NONE, states[:, 1], states[:, 0])
    open_ = (states != _NONE).all(axis=1) & (states[:, 0] != states[:, 1])
    if open_.any():
        path = np.array(C.solve(t, group.column("first")[0].as_py(), group.column("last")[0].as_py()))
        chosen = np.where(open_, states[np.arange(len(path)), path], chosen)
    return pa.table({"report_id": pa.repeat(key[0], len(numbers)), "line_number": numbers, "utc_micros": chosen}, schema=_CHOSEN_SCHEMA)


_CHOSEN_SCHEMA = pa.schema([("report_id", pa.int64()), ("line_number", pa.int64()), ("utc_micros", pa.int64())])


def choose(found: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """One reading of each record, by Viterbi over its report.  ``found`` is read twice; hand in a table."""
    chunked = with_chunk(found, size)
    chunks = chunked.groupBy("report_id", "chunk").agg(F.max(F.size("readings")).alias("most"))
    whole = Window.partitionBy("report_id")
    joined = chunks.select("report_id", "chunk", F.count("*").over(whole).alias("n"), F.max("most").over(whole).alias("most")).where("n > 1 and most > 1")
    several = chunked.join(small(joined.select("report_id", "chunk")), ["report_id", "chunk"], "left_semi")
    ends = several.groupBy("report_id", "chunk").applyInArrow(_summarise, _SUMMARY).groupBy("report_id").applyInArrow(_join_chunks, _ENDS)
    return chunked.join(ends, ["report_id", "chunk"], "left").groupBy("report_id", "chunk").applyInArrow(_choose, "report_id bigint, line_number bigint, utc_micros bigint")


def parsed_instants(parsed: DataFrame, reports: DataFrame) -> DataFrame:
    """What `instants` gives, of lines parsed with their times."""
    return choose(materialize(candidates(parsed, reports), "readings"))


def instants(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """``report_id, line_number, utc_micros`` of every line that states its own time.

    A time without zone is local in ``reports.tz_name``, one without year in the latest year not
    after ``captured_at``, one counted from boot starts at ``boot_at``; where what it needs is
    null, or the report isn't in ``reports``, the line has no row.  Null content is ignored, repeated
    lines count once, empty tables give no rows, extra columns are ignored.  Finer digits than
    microseconds are cut off.
    """
    return parsed_instants(parse_lines(lines, times=True, fields=False), reports)
