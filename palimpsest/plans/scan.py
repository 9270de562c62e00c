"""A scan of one domain: plan, rank, read pages, extract, and try once more if nothing was found.

Pages are read in waves, the best first, from a table of stored ones or from the archive by way of the page cache. When time is up, or the user
interrupts, the waves that are done are the result.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import vocabulary as V
from ..operators import captures as C
from ..operators import contacts, timeline
from ..sources.pages import Get, PageCache, load
from . import control, planner


@dataclass
class Scan:
    """Sightings and what is known of how they came about."""

    domain: str
    plan: planner.Plan
    sightings: DataFrame
    considered: int = 0
    fetched: int = 0
    notes: list[str] = field(default_factory=list)
    page_errors: DataFrame | None = None
    cache_hits: int = 0
    cache_misses: int = 0
    elapsed_seconds: float = 0.0
    timeout_exhausted: bool = False
    interrupted: bool = False
    index_truncated: bool = False
    index_failed: bool = False
    resolved_mode: str = ""
    single_url: str | None = None

    @property
    def rows(self) -> DataFrame:
        return timeline.report(self.sightings)

    def each_error(self) -> Iterator[str]:
        """What went wrong, of the scan and then of every page; pages stream."""
        yield from self.notes
        if self.page_errors is not None:
            yield from (r.error for r in self.page_errors.orderBy("error").toLocalIterator())

    @property
    def errors(self) -> list[str]:
        return list(self.each_error())


def host_regions(domain: str, defaults=V.SCAN_REGIONS) -> list[str]:
    """The domain's own region, then the defaults."""
    tld = domain.rpartition(".")[2].lower() if "." in domain else ""
    return list(dict.fromkeys([r for r in (V.TLD_REGION.get(tld),) if r] + list(defaults)))


def candidates(captures: DataFrame, domain: str, plan: planner.Plan, *, subdomains: bool = True, from_year: int | None = None, to_year: int | None = None, single_url: str | None = None) -> DataFrame:
    """What the index gives under the plan, one capture per URL and year, or per URL and time if time is unlimited."""
    own = C.matching(captures, single_url or domain, subdomains and not single_url)
    words = V.ASCII_SLUGS if plan.filtered and not single_url else None
    rows = C.oversampled(C.filtered(own, from_year, to_year, urlkey_words=words), None if single_url else plan.index_limit)
    return C.one_per_stamp(rows) if plan.unlimited else C.one_per_year(rows)


def should_probe(plan: planner.Plan, index_empty: bool, wanted: bool = True) -> bool:
    """Well-known paths are asked for unless a counted domain's whole index has been read, or holds no HTML at all."""
    known = plan.precise and bool(plan.estimated)
    return wanted and not (known and (index_empty or not plan.filtered))


#: Waves of a scan, and the pages from which on it has more than one.
WAVES, WAVE_PAGES = 8, 50


@dataclass
class Source:
    """Where page bodies come from: a table (timestamp, original, content, error), or fetching by way of a cache."""

    pages: DataFrame | None = None
    get: Get | None = None
    cache: PageCache | None = None
    workers: int = 4
    rate: float = 4.0

    def read(self, chosen: DataFrame, seconds: float | None) -> DataFrame:
        """timestamp, original, content, error, cached of each capture; fetching ends by itself when its time is up."""
        if self.pages is None:
            found = load(chosen, self.cache, self.get, workers=self.workers, rate=self.rate, seconds=seconds)
            return found.select("timestamp", "original", "content", "error", "cached")
        read = chosen.join(self.pages, ["timestamp", "original"], "left")
        error = F.when(F.col("content").isNull(), F.coalesce("error", F.lit("not stored"))).otherwise(F.col("error"))
        return read.select("timestamp", "original", "content", error.alias("error"), F.lit(False).alias("cached"))


def in_waves(chosen: DataFrame, bounded: bool) -> tuple[DataFrame, int]:
    """chosen (persisted) with a wave number, and how many there are: by rank where a capacity bounds them, else by a hash."""
    n = chosen.count()
    waves = min(WAVES, max(1, n // WAVE_PAGES))
    if waves == 1:
        return chosen.withColumn("wave", F.lit(0)), 1
    if bounded:
        return chosen.withColumn("at", F.monotonically_increasing_id()).withColumn("wave", F.ntile(waves).over(Window.orderBy("at")) - 1).drop("at"), waves
    return chosen.withColumn("wave", F.pmod(F.xxhash64("timestamp", "original"), F.lit(waves))), waves


def _once(captures, source: Source, domain, plan, *, min_score, well_known, extra_paths, regions, single_url, progress, index_seconds=None, **limits) -> Scan:
    began = time.monotonic()
    spark, notes, failed = captures.sparkSession, [], False
    left = lambda: None if plan.unlimited else max(0.0, plan.deadline - time.monotonic())
    index = candidates(captures, domain, plan, single_url=single_url, **limits).persist()
    passing = []  # what isn't needed once the waves are done
    try:
        budget = min((x for x in (index_seconds, None if plan.unlimited else planner.index_budget(plan.timeout_seconds), left()) if x is not None), default=None)
        try:
            found, cut = control.within(spark, budget, index.count)
        except Exception as e:  # the index can't be read: probing goes on without it
            notes, failed, found, cut = [f"index: {str(e).splitlines()[0]}"], True, None, False
        if found is None:
            index.unpersist()
            index, found = spark.createDataFrame([], C.COLUMNS), 0
        bound = None if plan.unlimited else plan.capacity
        chosen = C.ranked(index, bound, min_score, newest_first=single_url is None)
        considered = found
        if single_url is None and should_probe(plan, not found, well_known):
            own = C.matching(captures, domain)
            base = f"http://{domain}"
            answered = C.nearest(own, C.probes(captures, base, extra=extra_paths)).persist()
            passing.append(answered)
            considered += C.needed(answered).count()  # the others bring the same captures
            chosen = C.with_probes(chosen, answered, bound)
        chosen = chosen.select("timestamp", "original").persist()
        passing.append(chosen)
        numbered, waves = in_waves(chosen, bound is not None)
        seen, wrong, totals, late, interrupted = None, None, [0, 0, 0, 0], False, False

        def wave(k: int):
            read = source.read(numbered.where(F.col("wave") == k).drop("wave"), left()).persist()
            try:
                counts = timeline.scan_counts(read).first()
                here, bad = contacts.sightings(read, regions).persist(), contacts.errors(read).persist()
                here.count(), bad.count()
                return here, bad, counts
            finally:
                read.unpersist()

        for k in range(waves):
            try:
                done, out_of_time = control.within(spark, left(), lambda k=k: wave(k))
            except KeyboardInterrupt:
                interrupted = True
                break
            if out_of_time:
                late = True
                break
            here, bad, counts = done
            seen, wrong = (here if seen is None else seen.unionByName(here)), (bad if wrong is None else wrong.unionByName(bad))
            totals = [a + b for a, b in zip(totals, (counts.fetched, counts.errors, counts.hits, counts.misses), strict=True)]
            if progress is not None:
                progress.step("pages", totals[0], considered)
        if seen is None:
            seen = spark.createDataFrame([], ", ".join(f"{c} string" for c in contacts.SIGHTINGS))
        fetched, errors, hits, misses = totals
        late = late or time.monotonic() > plan.deadline
        return Scan(domain, plan, seen, considered, fetched - errors, notes, wrong, hits, misses, time.monotonic() - began, late, interrupted, cut, failed, single_url=single_url)
    finally:
        index.unpersist()
        for df in passing:
            df.unpersist()


def scan(captures: DataFrame, pages: DataFrame | None, domain: str, *, timeout: float | None = None, mode: str | None = None, workers: int = 4, rate: float = 4.0, force_all: bool = False,
         most: int | None = None, latency: float = 0.6, min_score: int = 0, from_year: int | None = None, to_year: int | None = None, subdomains: bool = True, well_known: bool = True,
         extra_paths=(), regions=V.SCAN_REGIONS, single_url: str | None = None, escalate: bool = True, get: Get | None = None, cache: PageCache | None = None,
         index_seconds: float | None = None, progress: control.Progress | None = None) -> Scan:
    """Contacts of a domain, or of one URL, from captures (timestamp, original, mimetype, status, urlkey) and pages (timestamp, original, content, error).

    Without `pages`, `get` fetches what `cache` doesn't hold. `progress` is told of each wave and warns when nothing moves.
    """
    seconds, everything = planner.mode(mode or "auto")
    timeout = seconds if timeout is None else timeout
    own = C.matching(captures, domain).persist()
    watch = progress.watch() if progress is not None else lambda: None
    unknown: list[str] = []

    def size(action):
        """A size that can't be had is unknown, and the scan says why."""
        try:
            return action()
        except Exception as e:
            unknown.append(f"size: {str(e).splitlines()[0]}")
            return None

    try:
        pages_of_index = size(lambda: C.num_pages(own).first().pages)
        plan = planner.make(pages=pages_of_index, exact=lambda: size(lambda: C.count(own).first().captures), timeout=timeout, workers=workers, rate=rate, force_all=force_all or everything, most=most, latency=latency)
        options = {"min_score": min_score, "well_known": well_known, "extra_paths": extra_paths, "regions": host_regions(domain, regions), "single_url": single_url, "from_year": from_year, "to_year": to_year, "subdomains": subdomains, "progress": progress, "index_seconds": index_seconds}
        if plan.no_captures and not single_url:
            empty = captures.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in contacts.SIGHTINGS))
            return Scan(domain, plan, empty, resolved_mode=planner.resolved_mode(mode, plan))
        source = Source(pages, get, cache, workers, rate)
        found = _once(own if not single_url else captures, source, domain, plan, **options)
        if escalate and not single_url and not found.index_failed and not found.interrupted and found.sightings.isEmpty():
            again = planner.broaden(plan) if plan.filtered else planner.extend(plan, plan.timeout_seconds) if found.timeout_exhausted else None
            if again is not None:
                found = _once(own, source, domain, again, **options)
        found.notes = unknown + found.notes
        found.resolved_mode = planner.resolved_mode(mode, plan)
        return found
    finally:
        watch()
        own.unpersist()


#: Hints at the end of a report.
MORE_TIME = "Timeout exhausted after {s:.0f}s; `--timeout {twice}` reads longer, `--all` reads every URL."
MORE_OF_URL = "Timeout exhausted after {s:.0f}s; `--timeout {twice}` reads more captures of this URL."
NO_FILTER = "Contact-URL filter was on, so only URLs that look like contact pages were read; `--all` or `--exhaustive` reads the others too."


def hint(s: Scan) -> str | None:
    """What to try next."""
    limited = s.plan.timeout_seconds > 0
    if s.timeout_exhausted and limited:
        return (MORE_OF_URL if s.single_url else MORE_TIME).format(s=s.elapsed_seconds, twice=int(s.plan.timeout_seconds * 2))
    return NO_FILTER if s.plan.filtered and limited and not s.single_url else None


def single_host(url: str) -> str | None:
    from urllib.parse import urlparse

    parsed = urlparse(url.strip())
    return (parsed.netloc.split(":")[0].lower() or None) if parsed.scheme in ("http", "https") else None


__all__ = ["Scan", "candidates", "hint", "host_regions", "scan", "should_probe", "single_host", "urls"]
