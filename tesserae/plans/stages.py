"""Runs named stages in order, with their times, results kept and an optional stop."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Sequence
from typing import Any

Stage = tuple[str, Callable[[dict[str, Any]], Any]]


def run(stages: Sequence[Stage], stop_after_seconds: float | None = None) -> dict[str, Any]:
    """{"results", "seconds", "slowest", "stopped_after", "finished_at"}: each stage gets the results so far by name.

    With a limit, no further stage begins once one took longer than it.
    """
    results: dict[str, Any] = {}
    seconds: dict[str, float] = {}
    stopped = None
    for name, f in stages:
        began = time.perf_counter()
        results[name] = f(results)
        seconds[name] = time.perf_counter() - began
        if stop_after_seconds is not None and seconds[name] > stop_after_seconds:
            stopped = name
            break
    slowest = max(seconds, key=lambda k: seconds[k]) if seconds else None
    return {"results": results, "seconds": seconds, "slowest": slowest, "stopped_after": stopped, "finished_at": datetime.datetime.now().isoformat(timespec="seconds")}
