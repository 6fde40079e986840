"""Configuration: YAML of markers, record types and keywords; JSON of queries; saved indexes."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    """A configuration that can't be used."""


def load_yaml(path: str | Path) -> dict:
    """A YAML file; FileNotFoundError where there is none, yaml.YAMLError where it doesn't parse."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


class Config:
    """A loaded configuration; parts that are absent are empty."""

    def __init__(self, data: dict):
        self.data = data or {}

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls(load_yaml(path))

    @property
    def markers(self) -> tuple[tuple[str, str], ...]:
        """Name and pattern, in order; markers without pattern are left out."""
        found = self.data.get("boundary_markers") or {}
        return tuple((name, m["pattern"]) for name, m in found.items() if m and m.get("pattern"))

    @property
    def record_types(self) -> list[dict]:
        """Record types as a list, whether written as list or map."""
        found = self.data.get("record_types") or []
        if isinstance(found, dict):
            return [{"name": k, **(v or {})} for k, v in found.items()]
        return list(found)

    @property
    def interest_points(self) -> list[dict]:
        return list(self.data.get("interest_points") or [])

    @property
    def metadata(self) -> dict:
        return self.data.get("metadata") or {}

    @property
    def keyword_groups(self) -> dict[str, list[str]]:
        return self.data.get("keywords") or {}

    @staticmethod
    def subsections_of(record_type: dict) -> list[dict]:
        """Subsections of one record type, whether written as list or map."""
        subs = record_type.get("subsections") or []
        return [{"name": k, **(v or {})} for k, v in subs.items()] if isinstance(subs, dict) else list(subs)

    @property
    def subsections(self) -> list[dict]:
        """Subsections of all record types, each with the name of its ``parent_record_type``."""
        return [{**s, "parent_record_type": r.get("name")} for r in self.record_types for s in self.subsections_of(r)]


def load_queries(path: str | Path) -> list[dict]:
    """The ``queries`` of a JSON file; ConfigError if there is no such file or part."""
    if not Path(path).exists():
        raise ConfigError(f"no query file {path}")
    found = json.loads(Path(path).read_text(encoding="utf-8")).get("queries")
    if not found:
        raise ConfigError(f"{path} has no queries")
    names = [q.get("name") for q in found]
    if len(set(names)) < len(names):
        raise ConfigError("query names must differ")
    return found


def save_index(df: DataFrame, path: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> None:
    """Write an index table, sorted within files by its key so that lookups skip row groups, with Bloom filters of the keys."""
    first = [c for c in ("keyword", "query_name", "report_id", "line_number") if c in df.columns]
    writer = df.sortWithinPartitions(*first).write.mode("overwrite").option("compression", codec)
    for key in ("keyword", "query_name"):
        if key in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.partitionBy(*by).parquet(path)


def load_indexes(spark: SparkSession, root: str, names: tuple[str, ...] = ("sections", "keywords", "queries")) -> dict[str, DataFrame | None]:
    """The saved indexes under ``root``; None for those that aren't there."""
    out: dict[str, DataFrame | None] = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            out[name] = None
    return out
