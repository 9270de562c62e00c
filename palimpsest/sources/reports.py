"""Reports of a scan: CSV, JSON and text. Rows stream to the driver in order; a report is one local file."""

from __future__ import annotations

import csv
import io
import json
import re
from datetime import datetime
from itertools import islice
from pathlib import Path

from ..plans.scan import Scan, hint

# The columns of a CSV report, and where each comes from.
COLUMNS = {
    "kind": "kind", "value": "value", "value_human": "value_human", "value_raw": "value_raw", "first_seen": "first_seen", "last_seen": "last_seen",
    "sightings_count": "sightings", "first_archive_url": "first_url", "last_archive_url": "last_url",
}


def default_name(domain: str, now: datetime | None = None) -> str:
    safe = re.sub(r"[^A-Za-z0-9_.\-]+", "_", domain).strip("_") or "domain"
    return f"{safe}_{now or datetime.now():%Y%m%d_%H%M%S}.csv"


def write_csv(s: Scan, path: str | Path) -> int:
    """Number of rows written; the file begins with a byte-order mark and always has a header."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(COLUMNS)
        for row in s.rows.toLocalIterator():
            out.writerow([row[c] for c in COLUMNS.values()])
            n += 1
    return n


def to_json(s: Scan, csv_path: str | Path | None = None) -> str:
    named = {("sightings" if k == "sightings_count" else k): c for k, c in COLUMNS.items()}
    return json.dumps(
        {
            "domain": s.domain, "single_url": s.single_url, "timeout_seconds": s.plan.timeout_seconds, "elapsed_seconds": round(s.elapsed_seconds, 2), "timeout_exhausted": s.timeout_exhausted,
            "plan_rationale": s.plan.rationale, "url_filter_active": s.plan.filtered and not s.single_url, "snapshots_considered": s.considered, "snapshots_fetched": s.fetched,
            "hint": hint(s), "csv_path": str(csv_path) if csv_path else None, "contacts": [{k: r[c] for k, c in named.items()} for r in s.rows.toLocalIterator()], "errors": s.errors,
        },
        indent=2, ensure_ascii=False,
    )


def table(rows: list[list[str]], headers: list[str]) -> str:
    widths = [max(len(r[i]) for r in [headers, *rows]) for i in range(len(headers))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) for r in [headers, *rows]]
    return "\n".join([lines[0], "  ".join("─" * w for w in widths), *lines[1:]])


def to_text(s: Scan) -> tuple[str, str]:
    """What goes to standard output and to standard error."""
    out, rows = io.StringIO(), [[f"{r.kind:5}  {r.value_human}", r.first_seen, r.last_seen] for r in s.rows.toLocalIterator()]
    limit = f"{s.plan.timeout_seconds:.0f}s" if s.plan.timeout_seconds > 0 else "unlimited"
    print(f"URL: {s.single_url}" if s.single_url else f"Domain: {s.domain}", file=out)
    print(f"Timeout: {limit} | Elapsed: {s.elapsed_seconds:.1f}s | Considered: {s.considered:,} snapshots | Fetched: {s.fetched} | Distinct contacts: {len(rows)}", file=out)
    if s.plan.rationale:
        print(f"Plan: {s.plan.rationale}", file=out)
    if s.timeout_exhausted:
        print(f"(stopped at timeout — pass --timeout N{'' if s.single_url else ' or --all'} for more)", file=out)
    print("\n" + (table(rows, ["Contact", "First seen", "Last seen"]) if rows else "No contacts found."), file=out)
    first = list(islice(s.each_error(), 10))
    notes = [f"\nHint: {h}" for h in [hint(s)] if h] + (["\nErrors (first 10):", *(f"  - {e}" for e in first)] if first else [])
    return out.getvalue(), "\n".join(notes)
