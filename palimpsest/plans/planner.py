"""How much of a domain's history a scan reads, from its size, the time allowed and the measured latency."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace

UNBOUNDED = 10**9
OVERSAMPLE, LEAST_LIMIT = 5, 2000
ROWS_PER_PAGE, COUNTED_PAGES = 50_000, 2
#: seconds and whether every page is read, by mode.
MODES = {"auto": (300.0, False), "default": (300.0, False), "deep": (900.0, False), "exhaustive": (0.0, True)}


#: Reasons that a report gives for its plan; tools look for their first words.
FORCED = "--all forced: broad CDX scan of every HTML page, {capacity:,} captures at most"
NOTHING = "no captures of this domain are known"
FITS = "{total} ≤ {capacity:,} captures in the time given: broad CDX scan of every HTML page"
FILTERED = "contact-URL filter on: the best {capacity:,}{of} captures"
BROADENED = "broadened: the first pass found nothing, so every URL is read"
EXTENDED = "extended: the first pass found nothing, so there are {extra:.0f}s more"


@dataclass(frozen=True)
class Plan:
    timeout_seconds: float
    latency: float
    concurrency: int
    capacity: int
    deadline: float = math.inf
    pages: int | None = None
    estimated: int | None = None
    precise: bool = False
    no_captures: bool = False
    filtered: bool = False
    index_limit: int | None = None
    forced_all: bool = False
    rationale: str = ""

    @property
    def unlimited(self) -> bool:
        return self.timeout_seconds <= 0


def concurrency(workers: int, rate: float | None) -> int:
    most = max(1, workers)
    return most if not rate or rate <= 0 else min(most, max(1, int(rate)))


def capacity(timeout: float, parallel: int, latency: float, most: int | None = None) -> int:
    """Captures that fit the time; a timeout of 0 has none but the user's own bound."""
    fits = UNBOUNDED if timeout <= 0 else max(1, int(timeout * parallel / max(latency, 0.001)))
    return fits if most is None else most if timeout <= 0 else min(fits, most)


def index_limit(plan_capacity: int) -> int:
    return max(OVERSAMPLE * plan_capacity, LEAST_LIMIT)


def size(pages: int | None, exact) -> tuple[int | None, bool]:
    """Estimated captures and whether they are counted; `exact()` counts small domains, None where it can't."""
    if pages is None:
        return None, False
    counted = exact() if pages <= COUNTED_PAGES else None
    return (pages * ROWS_PER_PAGE, False) if counted is None else (counted, True)


def make(*, pages: int | None, exact, timeout: float, workers: int = 4, rate: float | None = 4.0, force_all: bool = False, most: int | None = None, latency: float = 0.6, now=time.monotonic) -> Plan:
    estimated, precise = size(pages, exact)
    parallel = concurrency(workers, rate)
    fits = capacity(timeout, parallel, latency, most)
    plan = Plan(float(timeout), latency, parallel, fits, now() + timeout if timeout > 0 else math.inf, pages, estimated, precise, precise and estimated == 0, forced_all=force_all)
    total = None if estimated is None else f"{'' if precise else '~'}{estimated:,}"
    if force_all:
        return replace(plan, rationale=FORCED.format(capacity=fits))
    if estimated is not None and estimated <= fits:
        why = NOTHING if plan.no_captures else FITS.format(total=total, capacity=fits)
        return replace(plan, rationale=why)
    of = f" of {total}" if estimated else ""
    return replace(plan, filtered=True, index_limit=index_limit(fits), rationale=FILTERED.format(capacity=fits, of=of))


def broaden(plan: Plan, deadline: float | None = None) -> Plan:
    """The plan without its URL filter, the index still bounded."""
    return replace(plan, deadline=plan.deadline if deadline is None else deadline, filtered=False, index_limit=index_limit(plan.capacity), rationale=BROADENED)


def extend(plan: Plan, extra: float, now=time.monotonic) -> Plan:
    """The plan with more time, and the capacity that goes with it; an unlimited one as it is."""
    if plan.unlimited or math.isinf(plan.deadline):
        return plan
    more = int(extra * plan.concurrency / max(plan.latency, 0.001))
    return replace(plan, deadline=now() + extra, timeout_seconds=plan.timeout_seconds + extra, capacity=max(plan.capacity, more), rationale=EXTENDED.format(extra=extra))


def mode(name: str) -> tuple[float, bool]:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; one of {', '.join(MODES)}")
    return MODES[name]


def resolved_mode(asked: str | None, plan: Plan) -> str:
    if asked not in (None, "auto"):
        return asked
    if plan.unlimited:
        return "exhaustive"
    return ("deep" if plan.timeout_seconds >= 900 else "default") if plan.filtered else "all"


def index_budget(timeout: float) -> float:
    """Seconds that the index may take of the whole."""
    return max(30.0, 0.3 * timeout)
