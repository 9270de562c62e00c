"""Registered queries that run whole parts of the engine: fetching, cache, stored answers, scans, reports, plans, streams."""

from __future__ import annotations

import csv
import json
import tempfile
import uuid
from datetime import datetime
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import CAPTURES, HUMAN_SQL, ORACLES, PAGE_SIGHTED, TEXTS_SQL, emails_sql, literal, made_captures, made_sightings, page_errors, page_probes, page_sightings, phones_sql, quoted, query, table, values
from .functions import vocabulary as V
from .operators import captures as C
from .operators import contacts, timeline
from .plans import planner
from .plans import scan as S
from .sources import index, pages, reports, targets
from .streaming import feed


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}" if base else f"file://{tempfile.mkdtemp(prefix='palimpsest-')}/{uuid.uuid4().hex}"


# --- Fetching and cache -----------------------------------------------------------------------------------------------


def answer(url: str) -> tuple[int, str, str]:
    """What a stand-in archive says, by the length of a URL."""
    kind = len(url) % 5
    if kind == 4:
        raise ConnectionError("down")
    return [(200, "text/html", f"body of {url}"), (404, "text/html", ""), (200, "image/png", "x"), (200, "", "")][kind]


PLAYBACK_SQL = f"('{V.ARCHIVE}' || \"timestamp\" || 'id_/' || original)"
FETCHED_SQL = f"""(SELECT "timestamp", original, CASE length(u) % 5 WHEN 1 THEN 404 WHEN 4 THEN 0 ELSE 200 END AS status, CASE length(u) % 5 WHEN 0 THEN 'body of ' || u ELSE '' END AS content,
  CASE length(u) % 5 WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'non-html: image/png' WHEN 4 THEN 'ConnectionError: down' END AS error FROM (SELECT "timestamp", original, {PLAYBACK_SQL} AS u FROM {CAPTURES}))"""


def fetched(spark: SparkSession, d: str) -> DataFrame:
    return pages.fetch(made_captures(spark, d), answer, workers=4, rate=0, retries=1)


@query(f"SELECT * FROM {FETCHED_SQL}")
def fetched_pages(spark, d):
    """Every capture fetched in parallel; failures are told apart."""
    return fetched(spark, d)


@query(f"SELECT \"timestamp\", original, content <> '' AS kept FROM {FETCHED_SQL}")
def cached_pages(spark, d):
    """Which captures the cache holds after all were fetched: good pages that aren't empty."""
    cache = pages.PageCache(spark, folder(spark))
    cache.put(fetched(spark, d))
    hits, missing = cache.get(made_captures(spark, d).select("timestamp", "original"))
    return hits.select("timestamp", "original", F.lit(True).alias("kept")).unionByName(missing.withColumn("kept", F.lit(False)))


@query(f"SELECT cached, count(*) AS pages, count(error) AS errors FROM (SELECT content <> '' AS cached, CASE WHEN content = '' THEN error END AS error FROM {FETCHED_SQL}) GROUP BY cached")
def loaded_twice(spark, d):
    """A second load takes from the cache what the first one fetched, and fetches the rest again."""
    cache, asked = pages.PageCache(spark, folder(spark)), made_captures(spark, d)
    pages.load(asked, cache, answer, workers=4, rate=0, retries=1).count()
    return pages.load(asked, cache, answer, workers=4, rate=0, retries=1).groupBy("cached").agg(F.count(F.lit(1)).alias("pages"), F.count("error").alias("errors"))


@query(f"SELECT count(*) AS kept, count(*) AS cleared, 0 AS remaining FROM {FETCHED_SQL} WHERE content <> ''")
def cache_size_and_clear(spark, d):
    cache = pages.PageCache(spark, folder(spark))
    cache.put(fetched(spark, d))
    size = cache.size()
    return spark.createDataFrame([(size, cache.clear(), cache.size())], "kept long, cleared long, remaining int")


# --- Index ------------------------------------------------------------------------------------------------------------


@query(f"SELECT \"timestamp\", original, mimetype, status, urlkey FROM {CAPTURES}")
def stored_answers(spark, d):
    """Captures written as the archive's JSON answers, one a page, and read back."""
    named = F.to_json(F.array(*(F.col(c) for c in ("urlkey", "timestamp", "original", "mimetype", "status"))))
    header = json.dumps(["urlkey", "timestamp", "original", "mimetype", "statuscode"])
    bodies = made_captures(spark, d).select("page_id", named.alias("row")).groupBy("page_id").agg(F.concat(F.lit(f"[{header},\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    path = folder(spark)
    bodies.select("value").repartition(8).write.option("lineSep", "\u0001").text(path)
    return index.read_answers(spark, path, separator="\u0001")


PATHS = ["# list", "/", "/contact ", "", "/about", "/contact", "  ", "/über"]


@query(f"SELECT path FROM (SELECT trim(path) AS path, min(pos) AS pos FROM {values(list(enumerate(PATHS)), 'pos, path')} WHERE trim(path) <> '' AND NOT starts_with(trim(path), '#') GROUP BY 1)")
def path_list(spark, d):
    return spark.createDataFrame([(p,) for p in targets.well_known(PATHS)], "path string")


URLS = [(u,) for u in ("http://Example.com/x", "https://a.example:8080/", "ftp://a.example/", "a.example", " http://b.example ", "http:///x", "")]


@query(f"SELECT u, nullif(lower(regexp_extract(trim(u), '^https?://([^/:?#]*)', 1)), '') AS host FROM {values(URLS, 'u')}")
def single_url_hosts(spark, d):
    return spark.createDataFrame([(u, S.single_host(u)) for u, in URLS], "u string, host string")


PAIRS = "(SELECT DISTINCT url, probe FROM pages, (SELECT unnest([" + quoted(V.PROBE_STAMPS) + "]) AS probe))"


@query(f"""SELECT url, count(DISTINCT "timestamp") AS captures, count(*) AS probes FROM (SELECT p.url, p.probe, arg_min(c."timestamp", abs(epoch(strptime(c."timestamp", '%Y%m%d%H%M%S')) - epoch(strptime(p.probe, '%Y%m%d'))) * 1e12 + cast(c."timestamp" AS BIGINT) / 1e3) AS "timestamp"
  FROM {PAIRS} p JOIN {CAPTURES} c ON c.original = p.url GROUP BY p.url, p.probe) GROUP BY url""")
def probes_by_url(spark, d):
    """How many captures all probes of a URL come to: those that one capture covers bring nothing new."""
    found = C.nearest(made_captures(spark, d), page_probes(spark, d))
    return found.groupBy("url").agg(F.countDistinct("timestamp").alias("captures"), F.count(F.lit(1)).alias("probes"))


TURNS = [(u, p, t) for u, answers in (("one", ["20200615"] * 5), ("five", ["20030101", "20070101", "20120101", "20170101", "20220101"]), ("twice", ["20030101", "20030101", "20110101", "20140101", "20210101"])) for p, t in zip(V.PROBE_STAMPS, answers, strict=True)]
ASKED = [("one", "19990101"), ("five", "19990101"), ("five", "20050101"), ("five", "20100101"), ("five", "20150101"), ("five", "20200101"), ("twice", "19990101"), ("twice", "20050101"), ("twice", "20100101"), ("twice", "20150101"), ("twice", "20200101")]


@query(f"SELECT url, probe FROM {values(ASKED, 'url, probe')}")
def probe_pruning(spark, d):
    """Probes that an earlier answer covers aren't needed."""
    return C.needed(spark.createDataFrame(TURNS, "url string, probe string, timestamp string")).select("url", "probe")


SECONDS_SQL = "cast(epoch(strptime({c}, '{f}')) AS BIGINT)"


@query(f"""SELECT url, unnest(list_transform(list_reduce(turns, lambda kept, t: CASE WHEN len(list_filter(kept, lambda k: t[1].a BETWEEN least(k.a, k.h) AND greatest(k.a, k.h))) > 0 THEN kept ELSE list_concat(kept, t) END, []), lambda k: k.p)) AS probe
  FROM (SELECT p.url, list([{{'a': {SECONDS_SQL.format(c='p.probe', f='%Y%m%d')}, 'h': {SECONDS_SQL.format(c='n.ts', f='%Y%m%d%H%M%S')}, 'p': p.probe}}] ORDER BY p.probe) AS turns FROM {PAIRS} p JOIN
  (SELECT q.url, q.probe, arg_min(c."timestamp", abs(epoch(strptime(c."timestamp", '%Y%m%d%H%M%S')) - epoch(strptime(q.probe, '%Y%m%d'))) * 1e12 + cast(c."timestamp" AS BIGINT) / 1e3) AS ts FROM {PAIRS} q JOIN {CAPTURES} c ON c.original = q.url GROUP BY q.url, q.probe) n
  ON n.url = p.url AND n.probe = p.probe GROUP BY p.url)""")
def probes_needed(spark, d):
    """Which probes of every page had to be asked."""
    return C.needed(C.nearest(made_captures(spark, d), page_probes(spark, d))).select("url", "probe")


# --- Scans ------------------------------------------------------------------------------------------------------------

DOMAIN = "site4.example"
REHOSTED = f"(SELECT * REPLACE ('http://' || CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || 'site' || (page_id % 5) || '.example/' || page_id AS original) FROM {CAPTURES})"
SCANNED = f"""(SELECT s.kind, s.value, s.raw, '{V.ARCHIVE}' || c."timestamp" || '/' || c.original AS snapshot_url, c."timestamp" AS "timestamp", c.original AS source_url FROM {REHOSTED} c
  JOIN (SELECT page_id, 'email' AS kind, value, raw FROM {emails_sql(TEXTS_SQL, 'page_id', 'text')} UNION ALL SELECT page_id, 'phone', value, raw FROM {phones_sql(TEXTS_SQL, 'page_id', 'text')}) s USING (page_id)
  WHERE c.status = '200' AND c.mimetype = 'text/html' AND (c.original LIKE 'http://{DOMAIN}/%' OR c.original LIKE 'http://www.{DOMAIN}/%'))"""


def rehosted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Captures of five domains, and their bodies."""
    host = F.concat(F.lit("http://"), F.when(F.col("page_id") % 2 == 0, "www.").otherwise(""), F.lit("site"), (F.col("page_id") % 5).cast("string"), F.lit(".example/"), F.col("page_id").cast("string"))
    found = made_captures(spark, d).withColumn("original", host)
    bodies = found.join(table(spark, d, "pages").select("page_id", F.col("html").alias("content")), "page_id").select("timestamp", "original", "content", F.lit(None).cast("string").alias("error"))
    return found.drop("page_id"), bodies


def scanned(spark: SparkSession, d: str, **options) -> S.Scan:
    return S.scan(*rehosted(spark, d), DOMAIN, timeout=0, **options)


def report_sql(sightings: str) -> str:
    key = "{'t': \"timestamp\", 's': source_url, 'k': kind, 'r': raw}"
    day = lambda c: f"{c}[1:4] || '-' || {c}[5:6] || '-' || {c}[7:8]"
    human = HUMAN_SQL.replace("CASE WHEN", "CASE WHEN starts_with(value, '+') IS FALSE THEN value WHEN", 1)
    return f"""(SELECT *, {human} AS value_human, {day('first_ts')} AS first_seen, {day('last_ts')} AS last_seen FROM (SELECT arg_min(kind, {key}) AS kind, value, min("timestamp") AS first_ts, max("timestamp") AS last_ts, count(*) AS sightings,
      arg_min(snapshot_url, {key}) AS first_url, arg_max(snapshot_url, {key}) AS last_url,
      (SELECT string_agg(raw, ' | ' ORDER BY seen) FROM (SELECT raw, min({key}) AS seen FROM {sightings} i WHERE i.value = o.value GROUP BY raw)) AS value_raw FROM {sightings} o GROUP BY value))"""


@query(f"SELECT * FROM {report_sql(SCANNED)}")
def scan_rows(spark, d):
    """A scan of one domain without a time limit: index, dedup, rank, bodies, contacts, timeline."""
    return scanned(spark, d).rows


@query(f"""SELECT count(*) AS considered, count(*) AS fetched, 'exhaustive' AS mode, 0 AS errors, (SELECT count(*) FROM {SCANNED}) AS sightings FROM {REHOSTED}
  WHERE status = '200' AND mimetype = 'text/html' AND (original LIKE 'http://{DOMAIN}/%' OR original LIKE 'http://www.{DOMAIN}/%')""")
def scan_facts(spark, d):
    """What a scan says of itself."""
    s = scanned(spark, d)
    return spark.createDataFrame([(s.considered, s.fetched, s.resolved_mode, len(s.errors), s.sightings.count())], "considered long, fetched long, mode string, errors int, sightings long")


@query(f"SELECT \"timestamp\", kind, value FROM {SCANNED} WHERE source_url = 'http://{DOMAIN}/199'")
def scan_of_one_url(spark, d):
    return scanned(spark, d, single_url=f"https://www.{DOMAIN}/199/").sightings.select("timestamp", "kind", "value")


@query(f"SELECT kind, value, count(*) AS sightings FROM {SCANNED} WHERE \"timestamp\" BETWEEN '20050101000000' AND '20121231235959' GROUP BY kind, value")
def scan_of_some_years(spark, d):
    return scanned(spark, d, from_year=2005, to_year=2012).sightings.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("sightings"))


# --- Reports ----------------------------------------------------------------------------------------------------------


def made_scan(spark: SparkSession, d: str, **more) -> S.Scan:
    plan = planner.Plan(300.0, 0.5, 4, 2400, rationale="fits")
    return S.Scan("example.com", plan, page_sightings(spark, d), page_errors=page_errors(spark, d), **more)


PAGE_REPORT = report_sql(PAGE_SIGHTED)


@query(f"SELECT kind, value, value_human, value_raw, first_seen, last_seen, cast(sightings AS VARCHAR) AS sightings_count, first_url AS first_archive_url, last_url AS last_archive_url FROM {PAGE_REPORT}")
def report_csv(spark, d):
    """The CSV report, read back."""
    with tempfile.TemporaryDirectory() as here:
        reports.write_csv(made_scan(spark, d), Path(here) / "r.csv")
        with open(Path(here) / "r.csv", encoding="utf-8-sig", newline="") as file:
            rows = list(csv.DictReader(file))
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in reports.COLUMNS))


@query(f"SELECT kind, value, value_human, first_seen, sightings FROM {PAGE_REPORT}")
def report_json(spark, d):
    """The contacts of the JSON report."""
    told = json.loads(reports.to_json(made_scan(spark, d)))
    columns = ("kind", "value", "value_human", "first_seen", "sightings")
    return spark.createDataFrame([tuple(c[k] for k in columns) for c in told["contacts"]], "kind string, value string, value_human string, first_seen string, sightings long")


@query("SELECT url || ' @ 20100101000000: HTTP 404' AS error FROM pages WHERE page_id % 7 = 5")
def report_json_errors(spark, d):
    """All errors of the JSON report."""
    return spark.createDataFrame([(e,) for e in json.loads(reports.to_json(made_scan(spark, d)))["errors"]], "error string")


@query("SELECT url || ' @ 20100101000000: HTTP 404' AS error FROM pages WHERE page_id % 7 = 5 ORDER BY 1 LIMIT 10")
def report_text_errors(spark, d):
    """The first ten errors, as the text report lists them."""
    _, notes = reports.to_text(made_scan(spark, d))
    return spark.createDataFrame([(line[4:],) for line in islice(notes.partition("Errors (first 10):\n")[2].splitlines(), 10)], "error string")


@query(f"SELECT row_number() OVER (ORDER BY first_ts, kind, value) AS n, value_human, first_seen, last_seen FROM {PAGE_REPORT}")
def report_text_table(spark, d):
    """The table of the text report, in its order."""
    out, _ = reports.to_text(made_scan(spark, d))
    lines = out.partition("─\n")[2].splitlines() if "─\n" in out else []
    rows = [(n, line[5:-24].strip(), line[-22:-12].strip(), line[-10:].strip()) for n, line in enumerate((x.ljust(24) for x in lines), 1)]
    return spark.createDataFrame(rows, "n long, value_human string, first_seen string, last_seen string")


NAMED = [(n,) for n in ("example.com", "a b/c", "пример.рф", "__")]


@query(f"SELECT n, coalesce(nullif(trim(regexp_replace(n, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_'), ''), 'domain') || '_20200102_030405.csv' AS name FROM {values(NAMED, 'n')}")
def csv_names(spark, d):
    return spark.createDataFrame([(n, reports.default_name(n, datetime(2020, 1, 2, 3, 4, 5))) for n, in NAMED], "n string, name string")


HINTED = [(int(f), int(x), t, u) for f in (False, True) for x in (False, True) for t in (0, 300) for u in (None, "http://a.example/")]


@query(f"""SELECT f, x, t, u, CASE WHEN x = 1 AND t > 0 AND u IS NULL THEN 'more time or all' WHEN x = 1 AND t > 0 THEN 'more time' WHEN f = 1 AND t > 0 AND u IS NULL THEN 'all' END AS hint FROM {values(HINTED, 'f, x, t, u')}""")
def hints(spark, d):
    """Which way on a report points out."""
    rows = []
    for f, x, t, u in HINTED:
        said = S.hint(S.Scan("a.example", planner.Plan(t, 0.5, 4, 100, filtered=bool(f)), None, timeout_exhausted=bool(x), single_url=u))
        rows.append((f, x, t, u, said and ("more time" + " or all" * ("`--all`" in said) if said.startswith("Timeout exhausted") else "all")))
    return spark.createDataFrame(rows, "f int, x int, t int, u string, hint string")


# --- Plans ------------------------------------------------------------------------------------------------------------

GRID = [(p, e, t, int(a)) for p in (None, 0, 1, 3, 350) for e in (None, 0, 12, 90_000) for t in (0, 30, 900) for a in (False, True)]
SIZED = f"""(SELECT *, CASE WHEN t <= 0 THEN 1000000000 ELSE greatest(1, cast(floor(t * 4 / 0.5) AS BIGINT)) END AS fits, CASE WHEN p IS NULL THEN NULL WHEN p <= 2 AND e IS NOT NULL THEN e ELSE p * 50000 END AS estimated,
  p IS NOT NULL AND p <= 2 AND e IS NOT NULL AS counted FROM {values(GRID, 'p, e, t, a')})"""
BRANCHED = f"(SELECT *, a = 0 AND (estimated IS NULL OR estimated > fits) AS narrow FROM {SIZED})"


def plans_of_grid():
    for p, e, t, a in GRID:
        yield (p, e, t, a), planner.make(pages=p, exact=lambda e=e: e, timeout=t, force_all=bool(a), latency=0.5, now=lambda: 0.0)


@query(f"""SELECT p, e, t, a, fits AS capacity, cast(estimated AS BIGINT) AS estimated, counted AS precise, narrow AS filtered, CASE WHEN narrow THEN greatest(5 * fits, 2000) END AS index_limit, counted AND estimated = 0 AS nothing,
  CASE WHEN t <= 0 THEN 'exhaustive' WHEN narrow AND t >= 900 THEN 'deep' WHEN narrow THEN 'default' ELSE 'all' END AS mode, greatest(30.0, 0.3 * t)::DOUBLE AS index_seconds FROM {BRANCHED}""")
def plans(spark, d):
    """A plan for every size, time and wish."""
    rows = [(*k, m.capacity, m.estimated, m.precise, m.filtered, m.index_limit, m.no_captures, planner.resolved_mode("auto", m), float(planner.index_budget(k[2]))) for k, m in plans_of_grid()]
    return spark.createDataFrame(rows, "p int, e int, t int, a int, capacity long, estimated long, precise boolean, filtered boolean, index_limit long, nothing boolean, mode string, index_seconds double")


@query(f"""SELECT p, e, t, a, greatest(5 * fits, 2000) AS broad_limit, CASE WHEN t <= 0 THEN 0 ELSE t + 60 END::DOUBLE AS longer, CASE WHEN t <= 0 THEN fits ELSE greatest(fits, cast(floor(60 * 4 / 0.5) AS BIGINT)) END AS longer_capacity FROM {BRANCHED}""")
def plans_again(spark, d):
    """Each plan without its filter, and with a minute more."""
    rows = []
    for k, m in plans_of_grid():
        more = planner.extend(m, 60.0, now=lambda: 0.0)
        rows.append((*k, planner.broaden(m).index_limit, float(more.timeout_seconds), more.capacity))
    return spark.createDataFrame(rows, "p int, e int, t int, a int, broad_limit long, longer double, longer_capacity long")


MODES = [("auto", 300.0, 0), ("default", 300.0, 0), ("deep", 900.0, 0), ("exhaustive", 0.0, 1), ("fast", None, None)]


@query(f"SELECT name, seconds::DOUBLE AS seconds, every FROM {values(MODES, 'name, seconds, every')}")
def modes(spark, d):
    rows = []
    for name, _, _ in MODES:
        try:
            seconds, every = planner.mode(name)
            rows.append((name, seconds, int(every)))
        except ValueError:
            rows.append((name, None, None))
    return spark.createDataFrame(rows, "name string, seconds double, every int")


CLOCK = [(p, f, n, w) for p in (0, 1) for f in (0, 1) for n in (0, 1) for w in (0, 1)]


@query(f"SELECT p, f, n, w, w = 1 AND NOT (p = 1 AND (n = 1 OR f = 0)) AS probe FROM {values(CLOCK, 'p, f, n, w')}")
def probing(spark, d):
    """Whether well-known paths are asked for: not if a counted index was read whole, or holds no HTML."""
    rows = [(p, f, n, w, S.should_probe(planner.Plan(300.0, 0.5, 4, 100, estimated=50, precise=bool(p), filtered=bool(f)), bool(n), bool(w))) for p, f, n, w in CLOCK]
    return spark.createDataFrame(rows, "p int, f int, n int, w int, probe boolean")


# --- Streams ----------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT kind, value FROM {PAGE_SIGHTED}")
def stream_first_seen(spark, d):
    """Contacts as a stream of landing pages first shows them."""
    here = folder(spark)
    landed = table(spark, d, "pages").select(F.lit("20100101120000").alias("timestamp"), F.col("url").alias("original"), F.lit(200).alias("status"), F.col("html").alias("content"), F.lit(None).cast("string").alias("error"))
    landed.repartition(6).write.parquet(f"{here}/in")
    running = feed.start(feed.first_seen(feed.sightings(feed.landing(spark, f"{here}/in", files_per_batch=2))), f"{here}/out", f"{here}/state")
    if not feed.run_until(running, 600):
        raise TimeoutError("the stream didn't end")
    return spark.read.parquet(f"{here}/out").select("kind", "value")


#: All numbers, not the international ones alone.
EVERY_SIGHTED = ORACLES["sightings"].replace("SELECT * FROM ", "", 1).replace(" WHERE raw[1] = '+'", "", 1)


@query(f"SELECT kind, value, min(\"timestamp\") AS first_ts, count(*) AS sightings FROM {EVERY_SIGHTED} GROUP BY kind, value")
def report_of_documents(spark, d):
    """First sighting and number of every contact of the documents, from the report."""
    return timeline.report(made_sightings(spark, d, V.SCAN_REGIONS)).select("kind", "value", "first_ts", "sightings")


__all__ = ["contacts", "literal"]
