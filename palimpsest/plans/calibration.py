"""Measured fetch latency, kept in a JSON file for a fortnight."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path
from statistics import fmean, median

VERSION, FALLBACK, LEAST, AGE = 1, 0.6, 4, timedelta(days=14)


@dataclass(frozen=True)
class Calibration:
    version: int
    avg_latency_s: float
    sample_count: int
    last_calibrated_at: str
    samples_p50: float
    samples_p95: float
    user_agent: str = ""


def cache_path() -> Path:
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "palimpsest" / "calibration.json"


def summarise(samples: Sequence[float], user_agent: str = "") -> Calibration:
    stamp, s = datetime.now(UTC).isoformat(), sorted(samples)
    if len(s) < LEAST:
        return Calibration(VERSION, FALLBACK, len(s), stamp, FALLBACK, FALLBACK, user_agent)
    return Calibration(VERSION, fmean(s), len(s), stamp, median(s), s[max(0, int(0.95 * len(s)) - 1)], user_agent)


def is_stale(c: Calibration, now: datetime | None = None) -> bool:
    return (now or datetime.now(UTC)) - datetime.fromisoformat(c.last_calibrated_at) > AGE


def save(c: Calibration, path: Path | None = None) -> None:
    path = path or cache_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(asdict(c), indent=2))
    part.replace(path)


def load(path: Path | None = None) -> Calibration | None:
    """The kept calibration; None if there is none, it can't be read, is of another version or too old."""
    try:
        c = Calibration(**json.loads((path or cache_path()).read_text()))
        return None if c.version != VERSION or is_stale(c) else c
    except (OSError, ValueError, TypeError):
        return None


def run(fetch: Callable[[str], object], urls: Sequence[str], workers: int = 4) -> Calibration:
    """Time `fetch` over a few pinned captures; failures aren't counted."""

    def timed(url: str) -> float | None:
        began = time.monotonic()
        try:
            fetch(url)
        except Exception:
            return None
        return time.monotonic() - began

    with ThreadPoolExecutor(workers) as pool:
        return summarise([t for t in pool.map(timed, urls) if t is not None])


def ensure(fetch: Callable[[str], object], urls: Sequence[str], force: bool = False, path: Path | None = None) -> Calibration:
    if not force and (kept := load(path)):
        return kept
    made = run(fetch, urls)
    save(made, path)
    return made
