"""Boundary markers: which lines mark the structure of a report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.textnorm import stripped

# Name and pattern of each marker, in order of precedence.
MARKERS = (
    ("equals_separator", r"^={20,}$"),
    ("dash_separator", r"^------ .+ ------$"),
    ("duration_marker_major", r"^------ \d+\.\d+s was the duration of"),
    ("duration_marker_dumpsys", r"^---------+ \d+\.\d+s was the duration of dumpsys"),
    ("asterisk_separator", r"^\*{3,}.+\*{3,}$"),
    ("hash_separator", r"^#{3,}.+#{3,}$"),
    ("trace_start", r"^----- pid \d+ at"),
    ("trace_end", r"^----- end \d+$"),
    ("waiting_channels", r"^----- Waiting Channels:"),
    ("dumpsys_subheader", r"^---------+.+---------$"),
    ("kernel_timestamp", r"^\[\s*\d+\.\d+\]"),
    ("equals_with_text", r"^=+ .+ =+$"),
)

_any = re.compile("|".join(f"(?:{p[:-1] + chr(92) + 'Z' if p.endswith('$') else p})" for _, p in MARKERS)).match


def is_marker(line: str) -> bool:
    """Whether a stripped line is any marker."""
    return _any(line) is not None


def java_pattern(pattern: str) -> str:
    """A start-anchored pattern with Python's classes and end in Java's dialect."""
    p = pattern.replace("(?P<", "(?<")
    p = re.sub(r"(?<!\\)\$$", r"\\z", p)
    return f"(?Ud)^(?:{p})"


def match_types(content: Column, markers=MARKERS) -> Column:
    """Names of all markers a line matches once stripped, in their order; empty for blank lines."""
    line = stripped(content)
    each = [F.when(line.rlike(java_pattern(p)), F.lit(name)) for name, p in markers if p]
    if not each:
        return F.array().cast("array<string>")
    first = F.substring(line, 1, 1)
    known = all(re.match(r"\^(\\?[=\-*#\[])", p) for _, p in markers if p)
    found = F.array_compact(F.array(*each))
    none = F.array().cast("array<string>")
    cheap = F.when(first.isin("=", "-", "*", "#", "["), found).otherwise(none) if known else F.when(line == "", none).otherwise(found)
    return F.coalesce(cheap, none)


def boundaries(lines: DataFrame, markers=MARKERS) -> DataFrame:
    """Lines that are markers: ``lines`` with ``match_types array<string>``, at least one.

    Null content matches nothing; the content comes out as it was, not stripped.
    """
    return lines.withColumn("match_types", match_types(F.col("content"), markers)).where(F.size("match_types") > 0)
