"""Command line: contacts of one domain, one URL or a file of targets, from stored captures and pages."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import urls
from .functions import vocabulary as V
from .plans import calibration, planner
from .plans.control import Progress
from .plans.scan import scan, single_host
from .sources import index, reports, targets
from .sources.pages import PageCache, http_get


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("domain", nargs="?")
    p.add_argument("--targets-file")
    p.add_argument("--single-url")
    p.add_argument("--captures", help="Parquet: timestamp, original, mimetype, status, urlkey")
    p.add_argument("--pages", help="Parquet: timestamp, original, content, error; without it pages are fetched from the archive")
    timing = p.add_mutually_exclusive_group()
    timing.add_argument("--timeout", type=float, help="seconds for a scan; 0 has no limit")
    timing.add_argument("--mode", choices=sorted(planner.MODES), default=None)
    for name in sorted(planner.MODES):
        timing.add_argument(f"--{name}", action="store_const", const=name, dest="mode")
    p.add_argument("--all", action="store_true", dest="force_all", help="read every URL, not those alone that look like contact pages")
    p.add_argument("--calibrate", action="store_true", help="measure the archive's latency, keep it and end")
    p.add_argument("--recalibrate", action="store_true", help="measure it anew before the scan")
    p.add_argument("--no-escalate", action="store_true")
    p.add_argument("--from-year", type=int)
    p.add_argument("--to-year", type=int)
    p.add_argument("--no-subdomains", action="store_true")
    p.add_argument("--no-probe", "--no-well-known", action="store_true", dest="no_probe")
    p.add_argument("--extra-path", action="append", default=[])
    p.add_argument("--min-score", type=int, default=0)
    p.add_argument("--max-snapshots", type=int)
    p.add_argument("--workers", type=int, default=4)
    p.add_argument("--rate", type=float, default=4.0)
    p.add_argument("--cdx-timeout", type=float, default=300.0, help="seconds that reading the index may take")
    p.add_argument("--latency", type=float, help="seconds a page; else what was measured last, else 0.6")
    p.add_argument("--regions", default=",".join(V.SCAN_REGIONS))
    p.add_argument("--csv")
    p.add_argument("--no-csv", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--cache", help="folder of fetched pages, shared by all executors")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--clear-cache", action="store_true", help="remove all fetched pages and end")
    p.add_argument("--quiet", "--no-progress", action="store_true", dest="quiet")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-d", "--debug", action="store_true", help="log what Spark does")
    return p


def samples(captures, n: int = 8) -> list[str]:
    """Playback URLs of a few captures, always the same ones, to measure latency by."""
    rows = captures.where("status = '200' and mimetype = 'text/html'").orderBy(F.xxhash64("timestamp", "original"), "timestamp", "original").limit(n)
    return [r[0] for r in rows.select(urls.playback("timestamp", "original", raw=True)).collect()]


def main(argv: list[str] | None = None, get=http_get) -> int:
    a = parser().parse_args(argv)
    if a.clear_cache:
        n = PageCache(SparkSession.builder.appName("palimpsest").getOrCreate(), a.cache).clear()
        print(f"removed {n:,} pages", file=sys.stderr)
        return 0
    if not a.captures:
        print("--captures is needed", file=sys.stderr)
        return 2
    if a.calibrate:
        spark = SparkSession.builder.appName("palimpsest").getOrCreate()
        made = calibration.ensure(get, samples(index.read_captures(spark, a.captures)), force=True)
        print(f"{made.avg_latency_s:.2f} s a page over {made.sample_count} samples", file=sys.stderr)
        return 0
    if sum(map(bool, (a.domain, a.targets_file, a.single_url))) != 1:
        print("give exactly one of a domain, --targets-file and --single-url", file=sys.stderr)
        return 2
    try:
        if a.targets_file:
            wanted = [(d, paths, None) for d, paths in targets.read(a.targets_file)]
        elif a.single_url:
            host = single_host(a.single_url)
            if not host:
                raise ValueError(f"not an absolute http(s) URL: {a.single_url}")
            wanted = [(host, (), a.single_url)]
        else:
            wanted = [(targets.parse(a.domain)[0], (), None)]
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.csv and len(wanted) > 1:
        print("--csv names one file; it can't be used with several targets", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.debug else "WARN")
    progress = Progress(not a.quiet, a.verbose)
    captures = index.read_captures(spark, a.captures)
    pages = spark.read.parquet(a.pages) if a.pages else None
    cache = None if a.no_cache or pages is not None else PageCache(spark, a.cache)
    latency = a.latency
    if latency is None:  # measured on first use where pages are fetched
        known = calibration.ensure(get, samples(captures), force=a.recalibrate) if pages is None else calibration.load()
        latency = known.avg_latency_s if known else calibration.FALLBACK
    status, hits, misses = 0, 0, 0
    for domain, extra, url in wanted:
        if not a.quiet:
            progress.status(f"[*] {url or domain}")
        s = scan(
            captures, pages, domain, timeout=a.timeout, mode=a.mode, workers=a.workers, rate=a.rate, force_all=a.force_all, most=a.max_snapshots, latency=latency,
            min_score=a.min_score, from_year=a.from_year, to_year=a.to_year, subdomains=not a.no_subdomains, well_known=not a.no_probe,
            extra_paths=[*extra, *a.extra_path], regions=[r.strip().upper() for r in a.regions.split(",") if r.strip()], single_url=url, escalate=not a.no_escalate,
            get=get, cache=cache, index_seconds=a.cdx_timeout, progress=None if a.quiet else progress,
        )
        hits, misses = hits + s.cache_hits, misses + s.cache_misses
        if not a.quiet:
            for r in s.rows.toLocalIterator():
                progress.contact(r.kind, r.value_human, r.first_seen, r.first_url)
        csv_path = None if a.no_csv else a.csv or (None if a.json else reports.default_name(domain))
        if csv_path:
            reports.write_csv(s, csv_path)
        if a.json:
            print(reports.to_json(s, csv_path))
        else:
            text, notes = reports.to_text(s)
            print(text, end="")
            print((f"CSV saved: {csv_path}" if csv_path else "") + notes, file=sys.stderr)
        if s.interrupted:  # what was found is in the report; no other target is begun
            print("Interrupted.", file=sys.stderr)
            status = 130
            break
    if cache is not None and hits + misses:
        print(f"[*] Cache: {hits:,} pages kept, {misses:,} fetched", file=sys.stderr)
    return status


if __name__ == "__main__":
    sys.exit(main())
