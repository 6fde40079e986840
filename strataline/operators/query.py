"""Queries over lines and over indexes: preset, ad hoc, many at once, by index, composite."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strataline.functions.textnorm import contained, contains_word, query_pattern
from strataline.operators.index import keyword_index
from strataline.operators.matching import EXPRESSIONS, containing, found_in, worker_automaton
from strataline.operators.sections import covering
from strataline.session import small

#: Queries matched in one pass by workers.
BLOCK = 20_000


@dataclass
class Query:
    """A named query of type keyword, regex or section."""

    name: str
    type: str
    pattern: str
    priority: str = "MEDIUM"
    description: str = ""
    enabled: bool = True

    @classmethod
    def of(cls, q: dict) -> Query:
        return cls(q["name"], (q.get("type") or "keyword").lower(), q.get("pattern") or "", q.get("priority") or "MEDIUM", q.get("description") or "", q.get("enabled", True) is not False)


@dataclass
class QuerySet:
    """Queries by name; names can't repeat."""

    queries: dict[str, Query] = field(default_factory=dict)

    def register(self, name: str, type: str, pattern: str, **more) -> Query:
        if name in self.queries:
            raise ValueError(f"there is a query {name}")
        q = self.queries[name] = Query(name, type, pattern, **more)
        return q

    @classmethod
    def from_table(cls, table: DataFrame) -> QuerySet:
        """Queries of a table, which is a stated set and held by the driver; a query without name is left out."""
        out = cls()
        for r in table.where("name is not null").toLocalIterator():
            q = Query.of(r.asDict())
            if q.name in out.queries:
                raise ValueError(f"query {q.name} repeats")
            out.queries[q.name] = q
        return out

    def asked(self, *types: str) -> list[Query]:
        """Queries of these types that are on and have a pattern."""
        return [q for q in self.queries.values() if q.enabled and q.pattern and q.type in types]


def condition(q: Query, content: Column) -> Column | None:
    """What a line must meet; None for queries that are off, empty, of unknown type or don't compile."""
    if not q.enabled or not q.pattern:
        return None
    if q.type == "keyword":
        return contains_word(content, q.pattern)
    if q.type == "regex":
        p = query_pattern(q.pattern)
        if p is None:
            warnings.warn(f"query {q.name}: pattern doesn't compile, left out", stacklevel=2)
            return None
        return content.rlike(p)
    return None


def preset(lines: DataFrame, index: DataFrame, keyword: str) -> DataFrame:
    """Lines at which the index has the keyword: ``report_id, line_number, content, keyword`` as the user wrote it.
    Indexed lines that don't exist are left out."""
    places = index.where(F.col("keyword") == keyword.lower()).select("report_id", "line_number").distinct()
    return lines.join(places, ["report_id", "line_number"], "left_semi").select("report_id", "line_number", "content", F.lit(keyword).alias("keyword"))


def scan(lines: DataFrame, keyword: str) -> DataFrame:
    """The same by a pass over all lines."""
    return lines.where(contains_word(F.col("content"), keyword)).select("report_id", "line_number", "content", F.lit(keyword).alias("keyword"))


class Router:
    """Asks the index for preset keywords it has, the lines for all others; remembers answers' plans."""

    def __init__(self, lines: DataFrame, keywords: list[str], index: DataFrame | None = None):
        self.lines, self.keywords, self.index = lines, {k.lower() for k in keywords}, index
        self.known: dict[str, DataFrame] = {}

    def is_preset(self, keyword: str) -> bool:
        return keyword.lower() in self.keywords

    def query(self, keyword: str) -> DataFrame:
        if keyword not in self.known:
            indexed = self.index is not None and self.is_preset(keyword)
            self.known[keyword] = preset(self.lines, self.index, keyword) if indexed else scan(self.lines, keyword)
        return self.known[keyword]


def section_matches(lines: DataFrame, sections: DataFrame, pattern: str) -> DataFrame:
    """Lines of the sections whose name holds ``pattern``, each once."""
    chosen = sections.where(contains_word(F.col("name"), pattern)).select("report_id", "start_line", "end_line")
    return covering(lines, chosen).select("report_id", "line_number", "content").distinct()


def _section_hits(lines: DataFrame, queries: list[Query], sections: DataFrame) -> DataFrame:
    """Hits of all section queries by one covering join; the names of a section's queries go with it."""
    names = F.array(*[F.lit(q.name) for q in queries])
    named = containing(sections.select("report_id", "name", "start_line", "end_line"), "name", [q.pattern for q in queries], "_found")
    chosen = named.where(F.size("_found") > 0).select("report_id", "start_line", "end_line", F.transform("_found", lambda i: F.get(names, i)).alias("_names"))
    inside = covering(lines.select("report_id", "line_number"), chosen)
    return inside.select(F.explode("_names").alias("query_name"), "report_id", "line_number").distinct()


def _matcher(shared):
    """Names of the queries each line meets: keywords by an automaton, regular expressions one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keywords, names, regexes = shared.value
        auto = worker_automaton(key, keywords)
        tried = [(re.compile(p, re.I).search, name) for p, name in regexes]
        for b in batches:
            at, found = [], []
            for i, (text, low) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                hit = [names[k] for k in found_in(auto, low)] + [name for search, name in tried if search(text)]
                at += [i] * len(hit)
                found += hit
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), b.column(0).take(index), b.column(1).take(index)], ["query_name", "report_id", "line_number"])

    return run


def _many_matched(lines: DataFrame, queries: QuerySet, block: int) -> DataFrame:
    """The same as by expressions for a set too large for one projection, one pass for each block of queries."""
    asked = [q for q in queries.asked("keyword", "regex") if q.type == "keyword" or query_pattern(q.pattern) is not None]
    text = lines.select("report_id", "line_number", "content", F.lower("content").alias("_low")).where("content is not null")
    kind = StructType([StructField("query_name", StringType()), *(lines.schema[c] for c in ("report_id", "line_number"))])
    parts = []
    for k in range(0, len(asked), block):
        of = asked[k : k + block]
        words = [q for q in of if q.type == "keyword"]
        shared = lines.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [q.pattern.lower() for q in words], [q.name for q in words], [(q.pattern, q.name) for q in of if q.type == "regex"]))
        parts.append(text.mapInArrow(_matcher(shared), kind))
    return reduce(DataFrame.unionByName, parts)


def many(lines: DataFrame, queries: QuerySet, sections: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``query_name, report_id, line_number`` of all queries, in one pass over the lines (and one for section queries, if any).

    Queries of type section match nothing unless ``sections`` are given.  Beyond ``EXPRESSIONS`` queries workers match
    them in blocks of ``block``.
    """
    content = F.col("content")
    if len(queries.asked("keyword", "regex")) > EXPRESSIONS:
        hits = _many_matched(lines, queries, block)
    else:
        words = queries.asked("keyword")
        names = contained(content, [q.name for q in words], [q.pattern for q in words])
        if each := [F.when(c, F.lit(q.name)) for q in queries.asked("regex") if (c := condition(q, content)) is not None]:
            names = F.concat(names, F.array_compact(F.array(*each)))
        hits = lines.select(F.explode(names).alias("query_name"), "report_id", "line_number")
    of_sections = queries.asked("section") if sections is not None else []
    return hits.unionByName(_section_hits(lines, of_sections, sections)) if of_sections else hits


def summary(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Match count of every query that has a name, 0 where it matched nothing."""
    counts = hits.groupBy("query_name").agg(F.count("*").alias("match_count"))
    about = queries.where("name is not null").select(F.col("name").alias("query_name"), "type", "pattern", "priority")
    return about.join(counts, "query_name", "left").select("query_name", "type", "pattern", "priority", F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"))


def by_priority(df: DataFrame, priorities=("CRITICAL", "HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """``priority_rank``: 1 for the most urgent, one more than the last for unknown and null priorities."""
    ranks = F.array(*map(F.lit, priorities))
    at = F.coalesce(F.array_position(ranks, F.upper("priority")), F.lit(0))
    return df.withColumn("priority_rank", F.when(at == 0, len(priorities) + 1).otherwise(at).cast("int"))


def _found_in(keyword: str, patterns) -> list[str]:
    """The patterns that are found in a keyword; those that don't compile aren't."""
    out = []
    for p in patterns:
        try:
            if p and re.search(p, keyword, re.I):
                out.append(p)
        except re.error:
            continue
    return out


def _finder(keyword: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_found_in(keyword, b.column(0).to_pylist()), pa.string())], ["pattern"])

    return run


def index_query(keyword: str, enhanced: DataFrame, custom: DataFrame, use_preset: bool = True, use_custom: bool = True) -> DataFrame:
    """``source, query_name, report_id, line_number`` of a keyword in both indexes; matches aren't made distinct.

    The custom index answers with its queries of type keyword whose pattern equals the keyword, case aside,
    and with those of type regex whose pattern is found *in the keyword*.  The distinct patterns are searched where they
    are; none is brought to the driver.
    """
    word = F.lit(keyword.lower())
    parts = []
    if use_custom:
        stored = custom.where("type = 'regex' and pattern is not null").select("pattern").distinct()
        found = stored.mapInArrow(_finder(keyword), "pattern string")
        reverse = custom.where("type = 'regex'").join(small(found), "pattern", "left_semi").select("query_name", "report_id", "line_numbers")
        equal = custom.where((F.col("type") == "keyword") & (F.lower("pattern") == word)).select("query_name", "report_id", "line_numbers")
        parts.append(equal.unionByName(reverse).select(F.lit("custom").alias("source"), "query_name", "report_id", F.explode("line_numbers").alias("line_number")).where("line_number is not null"))
    if use_preset:
        hits = enhanced.where((F.lower("keyword") == word) & F.col("line_number").isNotNull())
        parts.append(hits.select(F.lit("preset").alias("source"), F.lit(None).cast("string").alias("query_name"), "report_id", "line_number"))
    if not parts:
        raise ValueError("neither index is asked")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def index_answer(hits: DataFrame) -> DataFrame:
    """What an index query answers for each report: ``report_id, sources array<string>, total_matches``: the indexes that have
    matches, custom first, and the sum of their counts."""
    has = lambda source: F.max(F.col("source") == source)
    sources = F.array_compact(F.array(F.when(F.col("_c"), "custom_index"), F.when(F.col("_p"), "enhanced_index")))
    return hits.groupBy("report_id").agg(F.count("*").alias("total_matches"), has("custom").alias("_c"), has("preset").alias("_p")).select("report_id", sources.alias("sources"), "total_matches")


def composite(chunks: DataFrame, tokens: DataFrame, key: str, types: list[str] | None = None, time_range: tuple[str, str] | None = None, words: list[str] | None = None, any_word: bool = False) -> DataFrame:
    """Rows of ``chunks(key, record_type, ts)`` that are of one of ``types``, within the time (both ends included) and
    have all (or any) of the words; no rows if nothing is asked."""
    if not (types or time_range or words):
        return chunks.where(F.lit(False))
    out = chunks
    if types:
        out = out.where(F.col("record_type").isin(*types))
    if time_range:
        out = out.where(F.col("ts").between(F.lit(time_range[0]).cast("timestamp_ntz"), F.lit(time_range[1]).cast("timestamp_ntz")))
    if words:
        low = sorted({w.lower() for w in words})
        having = tokens.where(F.col("token").isin(*low)).groupBy(key).agg(F.count_distinct("token").alias("_n")).where(F.col("_n") >= (1 if any_word else len(low)))
        out = out.join(having.select(key), key, "left_semi")
    return out


def keyword_lines(lines: DataFrame, keyword: str) -> DataFrame:
    """Places of one keyword, for contexts."""
    return keyword_index(lines, [keyword]).select("report_id", "line_number")


def _any_of(patterns) -> str:
    """One pattern for any of them; if all begin with a letter, they are tried only where one of these stands."""
    each = "|".join(f"(?:{p})" for p in patterns)
    if all(re.match(r"[A-Za-z](?![?*{])", p) and "|" not in p for p in patterns):
        return f"(?iud)(?=[{''.join(sorted({p[0].lower() for p in patterns}))}])(?:{each})"
    return f"(?iud){each}"


def tagged(lines: DataFrame, rules) -> DataFrame:
    """``report_id, line_number, domain, focus, threshold_name, value`` of lines a knowledge rule holds for.

    A rule with a threshold wants a number in the line that is greater.
    """
    content = F.col("content")
    kind = "struct<domain:string,focus:string,threshold_name:string,value:double>"
    number = F.regexp_extract(content, r"(\d+(?:\.\d+)?)\s*(?:ms|frames|count)", 1).try_cast("double")
    by_patterns: dict[tuple, list[Column]] = {}  # rules of the same patterns try them once
    for domain, focus, patterns, name, least in rules:
        tag = F.struct(F.lit(domain).alias("domain"), F.lit(focus).alias("focus"), F.lit(name).cast("string").alias("threshold_name"), (number if name else F.lit(None).cast("double")).alias("value")).cast(kind)
        by_patterns.setdefault(tuple(patterns), []).append(F.when(number > F.lit(float(least)), tag) if name else tag)
    each = F.array(*[F.when(content.rlike(_any_of(patterns)), F.array(*tags)) for patterns, tags in by_patterns.items()])
    return lines.select("report_id", "line_number", F.explode(F.array_compact(F.flatten(F.array_compact(each)))).alias("_t")).select("report_id", "line_number", "_t.*")
