"""Many literal patterns in one column: expressions for a few, an automaton in Arrow batches for any number."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Most patterns that are tried as expressions of one projection; more go through an automaton, with the same result.
EXPRESSIONS = 300

_automata: dict[str, tuple] = {}


def worker_automaton(key: str, patterns: list[str]):
    """Automaton whose values are the positions of a pattern in ``patterns``; built once a worker while ``key`` is asked for."""
    if key not in _automata:
        places: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                places.setdefault(p, []).append(i)
        auto = ahocorasick.Automaton()
        for p, where in places.items():
            auto.add_word(p, where)
        auto.make_automaton()
        _automata.clear()
        _automata[key] = auto if places else None
    return _automata[key]


def found_in(auto, text: str | None) -> list[int]:
    """Positions of the patterns a text holds, in order."""
    if not text or auto is None:
        return []
    return sorted({i for _, where in auto.iter(text) for i in where})


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = worker_automaton(*shared.value)
        for b in batches:
            found = pa.array([found_in(auto, t) for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], b.schema.names)

    return run


def containing(df: DataFrame, column: str, patterns: list[str], out: str) -> DataFrame:
    """``df`` with ``out array<int>``: positions in ``patterns`` of those that ``column`` holds, case aside; empty patterns and
    nulls hold nothing.  The patterns are a stated query set; there may be any number of them."""
    low = [p.lower() for p in patterns]
    text = F.lower(F.col(column))
    if len(low) <= EXPRESSIONS:
        each = [F.when(F.contains(text, F.lit(p)), F.lit(i)) for i, p in enumerate(low) if p]
        return df.withColumn(out, F.array_compact(F.array(*each)) if each else F.array().cast("array<int>"))
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, low))
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))])
    return df.withColumn(out, text).mapInArrow(_finder(shared), schema)
