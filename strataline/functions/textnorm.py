"""Text rules as Column expressions: stripping, lines, matching, dialects of regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode's and the four separators Python also strips.
_SPACE = r"[\s\x1c-\x1f]"
#: Unicode's space separators.
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def right_stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){_SPACE}+\z", "")


def blanks_trimmed(c: Column) -> Column:
    """Text without space separators at either end, as DuckDB's ``trim`` leaves it; Spark's by itself takes only U+0020."""
    return F.trim(c, F.lit(_BLANKS))


def valid_text(c: Column) -> Column:
    """Text with invalid UTF-8 bytes dropped; valid rows are not touched."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.regexp_replace(F.make_valid_utf8(c), "\ufffd", ""))


def contains_word(content: Column, keyword: str) -> Column:
    """Case-insensitive substring; no character of the keyword is special."""
    return F.contains(F.lower(content), F.lit(keyword.lower()))


def contained(content: Column, names: list[str], words: list[str]) -> Column:
    """Array of the names whose word the content holds, case aside.  The content is put in lower case once, whatever the number of
    words: as elements of an array it is the variable of a function, which the optimiser doesn't write out again for each."""
    if not names:
        return F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w.lower()).alias("word")) for n, w in zip(names, words)])
    return F.flatten(F.transform(F.array(F.lower(content)), lambda low: F.transform(F.filter(pairs, lambda p: F.contains(low, p["word"])), lambda p: p["name"])))


def query_pattern(pattern: str) -> str | None:
    """A user's regular expression in Java's dialect, case-insensitive; None if it doesn't compile."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    p = pattern.replace("(?P<", "(?<")
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    p = re.sub(r"(?<!\\)\$$", r"\\z", p)
    return f"(?iud){p}"


def like_python(pattern: str) -> str:
    """A pattern for which, as in Python, only a line feed ends a line (Java also takes carriage return and others)."""
    return f"(?d){pattern}"


def text_pieces(c: Column) -> Column:
    """Lines of a text: ends at line feed, carriage return or both; a last end makes no empty line."""
    parts = F.split(c, "\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
