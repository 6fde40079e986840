"""Stages in order, up to the first that fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any, NamedTuple


class Stage(NamedTuple):
    """``run`` takes what the stages before made, by name, and gives its own; ``check`` says whether that will do."""

    name: str
    run: Callable[[dict[str, Any]], Any]
    check: Callable[[Any], bool] = lambda made: True


class Outcome(NamedTuple):
    """What came of a run: what was made by name, a ``(stage, status, seconds)`` for each stage, with status ``ok``, ``failed`` or
    ``skipped``, and the first stage's error, if one failed."""

    made: dict[str, Any]
    stages: list[tuple[str, str, float]]
    error: str | None

    @property
    def ok(self) -> bool:
        return self.error is None


def run(stages: Iterable[Stage], given: dict[str, Any] | None = None) -> Outcome:
    """Run stages in order; after one that raises or whose check says no, the rest are skipped."""
    made, seen, error = dict(given or {}), [], None
    for s in stages:
        if error is not None:
            seen.append((s.name, "skipped", 0.0))
            continue
        start = time.monotonic()
        try:
            made[s.name] = s.run(made)
            if not s.check(made[s.name]):
                error = f"{s.name}: what it made doesn't do"
        except Exception as e:
            error = f"{s.name}: {type(e).__name__}: {e}"
        seen.append((s.name, "ok" if error is None else "failed", time.monotonic() - start))
    return Outcome(made, seen, error)
