import io
import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators import captures as C
from palimpsest.operators import contacts, timeline
from palimpsest.plans import calibration, control, planner
from palimpsest.plans import scan as S
from palimpsest.sources import index, pages, reports, targets
from palimpsest.streaming import feed


def capture(stamp, url, mime="text/html", status="200"):
    return (stamp, url, mime, status, url.split("://")[1])


PAGES = [
    ("20030102000000", "http://romashka.example/contact", "<p>old@romashka.example +7 495 123-45-67</p>", None),
    ("20070102000000", "http://romashka.example/contact", "<p>old@romashka.example new@romashka.example</p>", None),
    ("20070303000000", "http://romashka.example/", "<p>nothing</p>", None),
    ("20080303000000", "http://romashka.example/about", None, "HTTP 404"),
]


@pytest.fixture(scope="module")
def archive(spark):
    kept = spark.createDataFrame([capture(t, u) for t, u, _, _ in PAGES], C.COLUMNS)
    return kept, spark.createDataFrame(PAGES, "timestamp string, original string, content string, error string")


def test_scan_recovers_contacts(archive):
    found = S.scan(*archive, "romashka.example", timeout=300)
    rows = {r.value: r for r in found.rows.collect()}
    assert set(rows) == {"old@romashka.example", "new@romashka.example", "+74951234567"}
    assert (rows["old@romashka.example"].first_seen, rows["old@romashka.example"].last_seen, rows["old@romashka.example"].sightings) == ("2003-01-02", "2007-01-02", 2)
    assert found.errors == ["http://romashka.example/about @ 20080303000000: HTTP 404"]
    assert (found.considered, found.fetched, found.resolved_mode) == (4, 3, "all")


def test_scan_of_nothing_and_of_one_url(archive):
    empty = S.scan(*archive, "other.example")
    assert empty.plan.no_captures and empty.sightings.isEmpty()
    one = S.scan(*archive, "romashka.example", single_url="http://romashka.example/contact")
    assert one.considered == 2 and one.sightings.select("value").distinct().count() == 3


def test_scan_escalates_once(spark):
    # A big domain: its contact is on a page without a contact word, so only the broad pass finds it.
    kept = spark.range(3000).select(F.lit("20050101000000").alias("timestamp"), F.concat(F.lit("http://big.example/p/q/r"), F.col("id").cast("string")).alias("original"))
    kept = kept.select("*", F.lit("text/html").alias("mimetype"), F.lit("200").alias("status"), F.col("original").alias("urlkey"))
    bodies = kept.select("timestamp", "original", F.lit("<p>x@big.example</p>").alias("content"), F.lit(None).cast("string").alias("error"))
    first = S.scan(kept, bodies, "big.example", timeout=30, escalate=False, well_known=False)
    assert first.plan.filtered and first.sightings.isEmpty()
    again = S.scan(kept, bodies, "big.example", timeout=30, well_known=False)
    assert not again.plan.filtered and not again.sightings.isEmpty()


def test_deduplication_and_ranking(spark):
    url = "http://a.example/x"
    rows = spark.createDataFrame([capture(t, url) for t in ("20180101000000", "20200101000000", "20220101000000", "20220601000000")], C.COLUMNS)
    assert sorted(r.timestamp for r in C.one_per_year(rows).collect()) == ["20180101000000", "20200101000000", "20220101000000"]
    assert C.one_per_stamp(rows.unionByName(rows)).count() == 4
    mixed = spark.createDataFrame([capture("2001", "http://a.example/contact"), capture("2003", "http://a.example/img/x"), capture("2002", "http://a.example/")], C.COLUMNS)
    assert [r.original for r in C.ranked(mixed, 2).collect()] == ["http://a.example/contact", "http://a.example/"]


def test_nearest_prefers_the_earlier(spark):
    url = "http://a.example/"
    rows = spark.createDataFrame([capture("20041231000000", url), capture("20050102000000", url)], C.COLUMNS)
    asked = spark.createDataFrame([(url, "20050101"), ("http://b.example/", "20050101")], "url string, probe string")
    assert [(r.url, r.timestamp) for r in C.nearest(rows, asked).collect()] == [(url, "20041231000000")]


def test_nearest_is_by_time_not_by_digits(spark):
    url = "http://a.example/"
    rows = spark.createDataFrame([capture(t, url) for t in ("20041231000000", "20050201000000", "19990101000000", "20300101", "bad")], C.COLUMNS)
    asked = spark.createDataFrame([(url, "20050101"), (url, "20050118"), (url, "1990"), (url, "2099")], "url string, probe string")
    assert {r.probe: r.timestamp for r in C.nearest(rows, asked).collect()} == {"20050101": "20041231000000", "20050118": "20050201000000", "1990": "19990101000000", "2099": "20300101"}


def test_nearest_against_brute_force(spark):
    r = random.Random(3)
    made = [(f"http://{u}.example/", datetime(2000, 1, 1) + timedelta(seconds=r.randrange(10**9))) for u in "abc" for _ in range(40)]
    rows = spark.createDataFrame([capture(f"{t:%Y%m%d%H%M%S}", u) for u, t in made], C.COLUMNS)
    probes = [datetime(2000, 1, 1) + timedelta(days=r.randrange(12000)) for _ in range(25)]
    asked = spark.createDataFrame([(f"http://{u}.example/", f"{p:%Y%m%d}") for u in "abcd" for p in probes], "url string, probe string")
    want = {(u, f"{p:%Y%m%d}"): min((abs(t - p), f"{t:%Y%m%d%H%M%S}") for v, t in made if v == u)[1] for u, _ in made for p in probes}
    assert {(x.url, x.probe): x.timestamp for x in C.nearest(rows, asked).collect()} == want


def test_one_url_is_one_key(spark):
    rows = spark.createDataFrame([("2005", u, "text/html", "200", k) for u, k in (("http://example.com/", "com,example)/"), ("https://www.example.com", ""), ("http://example.com/a", "com,example)/a"), ("http://s.example.com/", None))], C.COLUMNS)
    assert C.matching(rows, "example.com", subdomains=False).count() == 2 and C.matching(rows, "http://EXAMPLE.com:80/a/", subdomains=False).count() == 1
    assert C.matching(rows, "example.com").count() == 4


def test_latency_matches_sorted_samples(spark):
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 20, 101):
        x = [r.choice((0.5, 0.25, 1.0, r.randrange(1000) / 8)) for _ in range(n)]
        got = timeline.latency(spark.createDataFrame([(v,) for v in [*x, None]], "seconds double").repartition(3)).first()
        want = calibration.summarise(x)
        assert (got.n, got["mean"], got["median"], got["p95"]) == (n, pytest.approx(want.avg_latency_s), want.samples_p50, want.samples_p95)


def test_scan_fetches_what_the_cache_lacks(spark, archive, tmp_path):
    bodies = {f"{t}id_/{u}": c for t, u, c, _ in PAGES}
    get = lambda url: (200, "text/html", c) if (c := bodies.get(url.rpartition("/web/")[2])) else (404, "", "")
    cache = pages.PageCache(spark, str(tmp_path / "cache"))
    for hits in (0, 3):
        found = S.scan(archive[0], None, "romashka.example", get=get, cache=cache, rate=0, workers=2, timeout=300)
        assert found.sightings.select("value").distinct().count() == 3 and found.errors == ["http://romashka.example/about @ 20080303000000: HTTP 404"]
        assert (found.cache_hits, found.cache_misses, found.fetched) == (hits, 4 - hits, 3)


def many(spark, n=400):
    kept = spark.range(n).select(F.lit("20050101000000").alias("timestamp"), F.concat(F.lit("http://big.example/contact/"), F.col("id").cast("string")).alias("original"), F.lit("text/html").alias("mimetype"), F.lit("200").alias("status"))
    return kept.withColumn("urlkey", F.col("original")), kept.select("timestamp", "original", F.concat(F.lit("<p>a"), F.substring_index("original", "/", -1), F.lit("@big.example</p>")).alias("content"), F.lit(None).cast("string").alias("error"))


def test_waves_hold_every_page_once(spark):
    kept, bodies = many(spark)
    for limit in (300, 0):
        assert S.scan(kept, bodies, "big.example", timeout=limit, well_known=False).sightings.count() == 400


@pytest.mark.parametrize("ends", ["deadline", "interrupt"])
def test_waves_that_are_done_are_kept(spark, monkeypatch, ends):
    kept, bodies = many(spark)
    calls, real = [], control.within

    def within(session, seconds, action, **more):
        calls.append(1)
        if len(calls) == 4:  # the index, two waves, and then
            if ends == "interrupt":
                raise KeyboardInterrupt
            return None, True
        return real(session, seconds, action, **more)

    monkeypatch.setattr(control, "within", within)
    found = S.scan(kept, bodies, "big.example", timeout=300, well_known=False)
    assert found.sightings.count() == 100 and found.interrupted == (ends == "interrupt") and found.timeout_exhausted == (ends == "deadline")


def test_an_unknown_size_is_told(spark, archive, monkeypatch):
    monkeypatch.setattr(C, "num_pages", lambda df: df.select(F.expr("raise_error('no size')").alias("pages")))
    assert any("no size" in e for e in S.scan(*archive, "romashka.example").errors)


def test_plan_reaches_the_scan(spark, sf, tmp_path):
    spark.createDataFrame([capture("20050101000000", "http://a.example/x")], C.COLUMNS).write.parquet(str(tmp_path / "c"))
    df = C.filtered(index.read_captures(spark, str(tmp_path / "c")), 2005, 2006).select("original")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,200)" in plan and "urlkey" not in plan.partition("ReadSchema")[2]


def test_timeline_keeps_forms_in_order(spark):
    rows = [("phone", "+1", r, f"s{t}", t, "u") for r, t in ((" b ", "2002"), ("a", "2001"), ("b", "2003"), ("", "2000"))]
    made = timeline.rows(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in contacts.SIGHTINGS))).first()
    assert (made.value_raw, made.first_ts, made.last_ts, made.sightings, made.first_url) == ("a | b", "2000", "2003", 4, "s2000")


def test_sightings_do_not_depend_on_partitions(archive):
    one, many = (contacts.sightings(archive[1].repartition(n)).orderBy("value", "timestamp").collect() for n in (1, 7))
    assert one == many and timeline.rows(contacts.sightings(archive[1])).agg(F.sum("sightings")).first()[0] == len(one)


@pytest.mark.parametrize(("args", "limit"), [((120, 4, 0.5), 960), ((300, 4, 0.6), 2000), ((0, 4, 0.5), planner.UNBOUNDED), ((1, 1, 50), 1)])
def test_capacity(args, limit):
    assert planner.capacity(*args) == limit


def test_plans():
    made = planner.make(pages=350, exact=lambda: None, timeout=120, latency=0.5)
    assert made.filtered and made.index_limit == 4800 and made.estimated == 17_500_000
    assert planner.broaden(made).index_limit == 4800 and not planner.broaden(made).filtered
    assert planner.extend(made, 120).timeout_seconds == 240 and planner.extend(planner.make(pages=1, exact=lambda: 5, timeout=0), 9).unlimited
    small = planner.make(pages=1, exact=lambda: 12, timeout=300)
    assert (small.estimated, small.precise, small.filtered) == (12, True, False) and "12 ≤ 2,000" in small.rationale
    assert planner.make(pages=0, exact=lambda: 0, timeout=300).no_captures
    assert planner.make(pages=None, exact=None, timeout=1, force_all=True).index_limit is None
    assert planner.resolved_mode("auto", made) == "default" and planner.mode("deep") == (900.0, False)
    with pytest.raises(ValueError, match="unknown mode"):
        planner.mode("fast")


def test_calibration(tmp_path):
    path = tmp_path / "c.json"
    assert calibration.load(path) is None
    made = calibration.summarise([0.1 * k for k in range(1, 9)])
    assert made.samples_p95 == pytest.approx(0.7) and calibration.summarise([1.0]).avg_latency_s == 0.6
    calibration.save(made, path)
    assert calibration.load(path) == made
    assert calibration.is_stale(made, datetime.now(UTC) + timedelta(days=15))
    path.write_text("{}")
    assert calibration.load(path) is None
    assert calibration.ensure(lambda u: None, ["a"] * 8, path=path).sample_count == 8


def test_index_answers():
    assert index.captures_of('[["timestamp","original"],["1","u"],["2"],["","v"]]') == [{"timestamp": "1", "original": "u", "mimetype": "", "status": "", "urlkey": ""}]
    assert index.parse_rows('[["a"],\nbad\n["b"]]') == [["a"], ["b"]]
    answer = {"archived_snapshots": {"closest": {"available": True, "timestamp": "20050101000000", "url": "http://web.archive.org/web/20050101000000/https://a.example/"}}}
    assert index.closest(answer, "http://a.example/")["original"] == "https://a.example/"
    assert index.closest({"archived_snapshots": {}}, "u") is None


def test_fetching_and_cache(spark, tmp_path):
    answers, slept = iter([(429, "", ""), (200, "text/html", "x")]), []
    assert pages.fetch_one(lambda u: next(answers), "u", sleep=slept.append) == (200, "x", None) and slept == [1.5]
    assert pages.fetch_one(lambda u: (200, "image/png", "x"), "u")[2] == "non-html: image/png"
    assert pages.fetch_one(lambda u: (404, "", ""), "u", sleep=slept.append)[0] == 404 and slept[1:] == [3.0, 6.0]
    cache = pages.PageCache(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([("20050101000000", "http://a.example/"), ("20060101000000", "http://a.example/none")], "timestamp string, original string")
    get = lambda url: (200, "text/html", "body") if url.endswith("/") else (500, "", "")
    first = {r.original: r for r in pages.load(asked, cache, get, rate=0, retries=1).collect()}
    assert not first["http://a.example/"].cached and first["http://a.example/none"].error == "HTTP 500"
    assert cache.size() == 1
    second = {r.original: r.cached for r in pages.load(asked, cache, get, rate=0, retries=1).collect()}
    assert second["http://a.example/"] is True
    assert pages.fetch(asked, get, seconds=-1).count() == 0
    assert cache.clear() == 1 and cache.size() == 0


def test_the_default_cache_is_local(spark, monkeypatch, tmp_path):
    monkeypatch.delenv("PALIMPSEST_CACHE_DIR", raising=False)
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    assert pages.PageCache(spark).path == f"file://{tmp_path}/palimpsest/pages" and pages.PageCache(spark).size() == 0
    monkeypatch.setenv("PALIMPSEST_CACHE_DIR", "hdfs:///shared")
    assert pages.default_folder(spark) == "hdfs:///shared"


def test_targets(tmp_path):
    path = tmp_path / "t"
    path.write_text("# x\nexample.com\nhttps://Example.com:80/a/\nother.example/\nexample.com/a\n")
    assert targets.read(str(path)) == [("example.com", ("/a",)), ("other.example", ())]
    path.write_text("ok.example\n/only-path\n")
    with pytest.raises(ValueError, match=":2:"):
        targets.read(str(path))
    assert targets.well_known(["/a", "", "# c", "/a", "/b"]) == ("/a", "/b")
    with pytest.raises(ValueError, match="p:1"):
        targets.well_known(["a"], "p")


def test_reports(archive, tmp_path):
    s = S.scan(*archive, "romashka.example")
    assert reports.write_csv(s, tmp_path / "r.csv") == 3
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfkind,value,value_human,value_raw,first_seen,last_seen,sightings_count,first_archive_url,last_archive_url")
    told = json.loads(reports.to_json(s))
    assert told["contacts"][0]["sightings"] >= 1 and told["snapshots_considered"] == 4
    out, notes = reports.to_text(s)
    assert "Distinct contacts: 3" in out and "HTTP 404" in notes
    assert reports.default_name("a/b", datetime(2020, 1, 2, 3, 4, 5)) == "a_b_20200102_030405.csv"


def test_stream_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([("20050101000000", "http://a.example/", 200, "x@a.example", None), ("20060101000000", "http://a.example/", 200, "x@a.example y@a.example", None)], pages.PAGES)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = feed.first_seen(feed.sightings(feed.landing(spark, str(tmp_path / "in"))))
    assert feed.run_until(feed.start(found, str(tmp_path / "out"), str(tmp_path / "state")), 120)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x@a.example", "y@a.example"]
    endless = feed.start(feed.sightings(feed.landing(spark, str(tmp_path / "in"))), str(tmp_path / "o2"), str(tmp_path / "s2"), once=False)
    assert not feed.run_until(endless, 5) and not endless.isActive


def test_index_errors_and_time_limits(spark, archive, monkeypatch):
    monkeypatch.setattr(S, "candidates", lambda captures, *a, **b: captures.withColumn("urlkey", F.expr("if(timestamp > '', raise_error('damaged'), urlkey)")))
    found = S.scan(*archive, "romashka.example")
    assert found.index_failed and any("damaged" in e for e in found.errors)
    assert control.within(spark, 30, lambda: spark.range(5).count()) == (5, False)
    slow = lambda: spark.range(4).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L)")).collect()
    began = time.monotonic()
    assert control.within(spark, 1, slow) == (None, True) and time.monotonic() - began < 10
    with pytest.raises(ZeroDivisionError):
        control.within(spark, 5, lambda: 1 / 0)


def test_progress():
    out = io.StringIO()
    p = control.Progress(verbose=True, out=out, stall=0.1)
    assert p.contact("email", "a@b.example", "2005-01-01", "u") and not p.contact("email", "a@b.example")
    p.step("pages", 3, 10)
    end = p.watch(0.05)
    time.sleep(0.5)
    end()
    assert out.getvalue().count("no progress") == 1 and "2005-01-01  u" in out.getvalue() and "3 of 10" in out.getvalue()
    quiet = io.StringIO()
    control.Progress(False, out=quiet).step("x", 1)
    assert quiet.getvalue() == ""


def test_command_line(spark, archive, tmp_path, capsys):
    archive[0].write.parquet(str(tmp_path / "c"))
    archive[1].write.parquet(str(tmp_path / "p"))
    given = ["--captures", str(tmp_path / "c"), "--pages", str(tmp_path / "p"), "--quiet"]
    assert cli.main(given) == 2 and cli.main([*given, "--single-url", "ftp://x"]) == 2
    assert cli.main(["romashka.example", *given, "--json"]) == 0
    assert "old@romashka.example" in capsys.readouterr().out
    assert cli.main(["romashka.example", *given, "--no-csv", "--no-subdomains", "--deep"]) == 0 and cli.main(["romashka.example"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["romashka.example", *given, "--deep", "--timeout", "5"])


def test_command_line_fetches_and_calibrates(spark, archive, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "own"))
    archive[0].write.parquet(str(tmp_path / "c"))
    given, get = ["--captures", str(tmp_path / "c"), "--cache", str(tmp_path / "k"), "--rate", "0"], lambda url: (200, "text/html", "x@romashka.example")
    assert cli.main([*given, "--calibrate"], get=get) == 0 and calibration.load().sample_count == 4
    for said in ("0 pages kept, 4 fetched", "4 pages kept, 0 fetched"):
        assert cli.main(["romashka.example", *given, "--json"], get=get) == 0
        out = capsys.readouterr()
        assert "x@romashka.example" in out.out and said in out.err
    assert cli.main([*given, "--clear-cache"]) == 0 and "removed 4 pages" in capsys.readouterr().err
