"""The small query language:

    SELECT * [FROM section = "x"] [WHERE keyword = "k" [AND time BETWEEN "a" AND "b"]] [BEFORE 30s] [AND] [AFTER 30s]
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.textnorm import contains_word
from strataline.operators.query import section_matches
from strataline.operators.timing import between, time_context, timed


class LanguageError(ValueError):
    """A query that doesn't parse."""


@dataclass
class Parsed:
    keyword: str | None = None
    time_range: tuple[str, str] | None = None
    section: str | None = None
    before: int = 0
    after: int = 0


_TOKEN = re.compile(r'\s*(?:"([^"]*)"|(\d+)s\b|(\w+)|([*=]))')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise LanguageError(f"can't read {text[at:at + 20]!r}")
        quoted, seconds, word, sign = m.groups()
        out.append(("text", quoted) if quoted is not None else ("seconds", seconds) if seconds else ("word", word.upper()) if word else ("sign", sign))
        at = m.end()
    return out


def parse(text: str) -> Parsed:
    """Parse a query; LanguageError says where it fails."""
    tokens, out = _tokens(text), Parsed()
    at = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or tokens[at][0] != kind or (value is not None and tokens[at][1] != value):
            found = tokens[at][1] if at < len(tokens) else "the end"
            raise LanguageError(f"expected {value or kind}, found {found}")
        at += 1
        return tokens[at - 1][1]

    def peek(value: str) -> bool:
        return at < len(tokens) and tokens[at] == ("word", value)

    take("word", "SELECT")
    take("sign", "*")
    if peek("FROM"):
        take("word")
        take("word", "SECTION")
        take("sign", "=")
        out.section = take("text")
    if peek("WHERE"):
        take("word")
        while True:
            if peek("KEYWORD"):
                take("word")
                take("sign", "=")
                out.keyword = take("text")
            elif peek("TIME"):
                take("word")
                take("word", "BETWEEN")
                start = take("text")
                take("word", "AND")
                out.time_range = (start, take("text"))
            else:
                raise LanguageError("expected keyword or time")
            if not peek("AND") or (at + 1 < len(tokens) and tokens[at + 1][1] in ("BEFORE", "AFTER")):
                break
            take("word", "AND")
    while at < len(tokens):
        if peek("AND"):
            take("word")
        if peek("BEFORE"):
            take("word")
            out.before = int(take("seconds"))
        elif peek("AFTER"):
            take("word")
            out.after = int(take("seconds"))
        else:
            raise LanguageError(f"unexpected {tokens[at][1]}")
    return out


def full_time(text: str, day: str) -> str:
    """``HH:MM``, ``HH:MM:SS`` of ``day``, or a full time as it is."""
    if re.fullmatch(r"\d\d:\d\d", text):
        return f"{day} {text}:00"
    return f"{day} {text}" if re.fullmatch(r"\d\d:\d\d:\d\d(\.\d+)?", text) else text


def run(text: str | Parsed, lines: DataFrame, sections: DataFrame, year: int, day: str) -> DataFrame:
    """``report_id, line_number, content`` of the lines a query selects.

    Section, time and keyword narrow the lines, in any order Catalyst likes; then lines within the asked
    seconds of those are added.
    """
    q = parse(text) if isinstance(text, str) else text
    out = lines if q.section is None else section_matches(lines, sections, q.section)
    times = timed(lines, year)
    if q.time_range:
        start, end = (full_time(t, day) for t in q.time_range)
        out = out.join(between(times, start, end).select("report_id", "line_number"), ["report_id", "line_number"], "left_semi")
    if q.keyword is not None:
        out = out.where(contains_word(F.col("content"), q.keyword))
    if q.before or q.after:
        near = time_context(times, out, q.before, q.after)
        out = lines.join(near.unionByName(out.select("report_id", "line_number")).distinct(), ["report_id", "line_number"], "left_semi")
    return out.select("report_id", "line_number", "content")
