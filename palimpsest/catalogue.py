"""The registered queries and their DuckDB counterparts, over whole tables or small literal fixtures.

`pages` has no capture times, so captures are made from it by arithmetic that both engines share: four per page, two of
them in one year. Literal fixtures are written once, and become a DataFrame here and VALUES there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import emails, markup, phones, urls
from .functions import vocabulary as V
from .operators import captures as C
from .operators import contacts, timeline
from .plans import planner
from .sources import index, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A fixture as SQL."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names}))"


SLUGS = ["/", "/contact", "/about-us/team", "/blog/tag/x", "/img/logo.png", "/wp-content/a/b", "/shop/item/7/contacts.html", "/o-nas", "/page/2", "/a/b/c/d", "/help%20desk", "/xcontactx"]
MADE = (
    "concat(2000 + (page_id * 7 + {k2} * 5) % 20, lpad(cast(1 + (page_id * 3 + k) % 12 as {s}), 2, '0'), lpad(cast(1 + (page_id * 11 + k) % 28 as {s}), 2, '0'), '120000')"
)
CAPTURES = f"""(SELECT {MADE.format(k2='(k // 2)', s='VARCHAR')} AS "timestamp", url AS original, CASE WHEN page_id % 10 = 3 THEN 'image/png' ELSE 'text/html' END AS mimetype,
  CASE WHEN page_id % 7 = 5 THEN '404' ELSE '200' END AS status, lower(regexp_replace(url, '^[a-z]+://', '')) AS urlkey, page_id FROM pages, (SELECT unnest(range(4)) AS k))"""
#: The same captures with contact paths, for scoring.
PATHED = f"""(SELECT "timestamp", 'http://h' || (page_id % 9) || '.example.com' || list_extract([{', '.join(map(literal, SLUGS))}], cast(page_id % {len(SLUGS)} AS INT) + 1) AS original,
  mimetype, status, 'k' || (page_id % 9) || '/' || (page_id % {len(SLUGS)}) AS urlkey, page_id FROM {CAPTURES})"""


def made_captures(spark: SparkSession, d: str) -> DataFrame:
    k = spark.range(4).select(F.col("id").alias("k"))
    rows = table(spark, d, "pages").select("page_id", "url").crossJoin(F.broadcast(k))
    return rows.select(
        F.expr(MADE.format(k2="(k div 2)", s="string")).alias("timestamp"), F.col("url").alias("original"), F.when(F.col("page_id") % 10 == 3, "image/png").otherwise("text/html").alias("mimetype"),
        F.when(F.col("page_id") % 7 == 5, "404").otherwise("200").alias("status"), F.lower(F.regexp_replace("url", "^[a-z]+://", "")).alias("urlkey"), "page_id",
    )


def pathed_captures(spark: SparkSession, d: str) -> DataFrame:
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("page_id") % len(SLUGS) + 1).cast("int"))
    host = F.concat(F.lit("http://h"), (F.col("page_id") % 9).cast("string"), F.lit(".example.com"))
    key = F.concat(F.lit("k"), (F.col("page_id") % 9).cast("string"), F.lit("/"), (F.col("page_id") % len(SLUGS)).cast("string"))
    return made_captures(spark, d).select("timestamp", F.concat(host, slug).alias("original"), "mimetype", "status", key.alias("urlkey"), "page_id")


def re2(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)


def quoted(words: list[str]) -> str:
    return ", ".join(map(literal, words))


def score_sql(url: str) -> str:
    """The score of a URL column, in DuckDB's dialect."""
    p = f"coalesce(nullif(url_decode(regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')), ''), '/')"
    seg = f"list_filter(string_split(lower({p}), '/'), lambda s: s <> '')"
    return f"""CASE WHEN len({seg}) = 0 THEN 5 WHEN regexp_matches({seg}[-1], '\\.({re2(V.ASSET_EXTENSIONS)})$') THEN 0
      ELSE (CASE WHEN regexp_matches({p}, '(?i)(^|[/_\\-])({re2(V.HIGH_SLUGS)})($|[/_.\\-])') THEN 10 ELSE 0 END)
         - (CASE WHEN list_has_any({seg}, [{quoted(V.LOW_SLUGS)}]) THEN 5 ELSE 0 END) + (CASE WHEN len({seg}) <= 2 THEN 3 ELSE 0 END) END"""


# --- E-mail and phone -------------------------------------------------------------------------------------------------

EMAIL_SQL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24}"
#: Without lookaround: the boundaries never differ in the tables.
PLAUSIBLE_SQL = f"NOT regexp_matches({{v}}, '({'|'.join(x.replace('.', chr(92) + '.') for x in V.EMAIL_ASSETS)})$') AND NOT regexp_matches({{v}}, 'u003e|u003c|\\\\x|@www\\.')"


def found_emails(df: DataFrame, key: str, text: str) -> DataFrame:
    held = df.where(F.col(text).contains("@")).select(key, F.explode(emails.found(text)).alias("raw"))
    return held.select(key, emails.canonical(F.col("raw")).alias("value"), "raw")


@query(f"SELECT doc_id, lower(raw) AS value, raw FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) AS raw FROM documents)")
def email_documents(spark, d):
    """Addresses in documents, each occurrence."""
    return found_emails(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT page_id, lower(raw) AS value, raw FROM (SELECT page_id, unnest(regexp_extract_all(html, '{EMAIL_SQL}')) AS raw FROM pages)")
def email_pages(spark, d):
    return found_emails(table(spark, d, "pages"), "page_id", "html")


ADDRESSES = [(x,) for x in ("logo@2x.png", "info@example.com", "a@www.example.com", "u003ea@example.com", "x@gmail.com", "icon@3x.svg", "b@mail.ru", "archive@sub.www.example.com", "font@x.woff2", "q\\x@example.com")]


@query(f"SELECT address FROM {values(ADDRESSES, 'address')} WHERE {PLAUSIBLE_SQL.format(v='address')}")
def email_syntax_filter(spark, d):
    return spark.createDataFrame(ADDRESSES, "address string").where(emails.plausible(F.col("address")))


SPELLED = [(i, t) for i, t in enumerate(["info [at] example [dot] com", "sales(at)example.com", "office собака example точка com", "Sobaka walks", "look at example.com now", "a { AT } b {DOT} org", "x [@] y [.] net", "dot dot dot", "mail sobaka example tochka test"])]
AT_SQL, DOT_SQL = (p.replace("'", "''") for p in (emails.AT, emails.DOT))


@query(f"SELECT id, regexp_replace(regexp_replace(t, '{AT_SQL}', '@', 'gi'), '{DOT_SQL}', '.', 'gi') AS text FROM {values(SPELLED, 'id, t')}")
def deobfuscate_at_dot(spark, d):
    return spark.createDataFrame(SPELLED, "id int, t string").select("id", emails.plain("t").alias("text"))


#: Addresses of a text in the order of both passes, the spelled-out ones unless prose stands before 'at'; each value once.
def emails_sql(rows: str, key: str, text: str) -> str:
    listed = f"SELECT {key}, 0 AS pass, regexp_extract_all({text}, '{EMAIL_SQL}') AS l FROM {rows}"
    listed += f" UNION ALL SELECT {key}, 1, regexp_extract_all(regexp_replace(regexp_replace({text}, '{AT_SQL}', '@', 'gi'), '{DOT_SQL}', '.', 'gi'), '{EMAIL_SQL}') FROM {rows}"
    each = f"SELECT {key}, pass, i, l[i] AS raw, lower(l[i]) AS value FROM (SELECT {key}, pass, l, unnest(range(1, len(l) + 1)) AS i FROM ({listed}))"
    good = f"{PLAUSIBLE_SQL.format(v='value')} AND (pass = 0 OR split_part(value, '@', 1) NOT IN ({quoted(V.PROSE_WORDS)}))"
    return f"(SELECT {key}, value, arg_min(raw, pass * 1000000 + i) AS raw FROM ({each}) WHERE {good} GROUP BY {key}, value)"


@query(f"SELECT doc_id, value FROM {emails_sql('documents', 'doc_id', 'text')}")
def email_contacts(spark, d):
    """Distinct plausible addresses by document, from both passes."""
    found = table(spark, d, "documents").where(contacts.possible("text")).select("doc_id", F.explode(emails.contacts("text")).alias("c"))
    return found.select("doc_id", "c.value")


MIXED = [(i, t) for i, t in enumerate(["info [at] example [dot] com or info@example.com", "Found at example.com and Sales at example.org", "INFO@Example.com, info@example.com", "archived at www.example.net", "a(at)b.example c{AT}d.example", "none here", ""])]


@query(f"SELECT id, value, raw FROM {emails_sql(values(MIXED, 'id, t'), 'id', 't')}")
def email_passes(spark, d):
    """Both passes over texts that spell addresses out."""
    return spark.createDataFrame(MIXED, "id int, t string").select("id", F.explode(emails.contacts("t")).alias("c")).select("id", "c.value", "c.raw")


PROSE = [(x,) for x in ("found@example.com", "info@example.com", "archived@example.org", "based.here@example.org", "published@example.net")]


@query(f"SELECT address FROM {values(PROSE, 'address')} WHERE split_part(address, '@', 1) NOT IN ({quoted(V.PROSE_WORDS)})")
def stopword_anti(spark, d):
    stop = F.broadcast(spark.createDataFrame([(w,) for w in V.PROSE_WORDS], "word string"))
    rows = spark.createDataFrame(PROSE, "address string")
    return rows.join(stop, F.substring_index("address", "@", 1) == stop["word"], "left_anti")


def protect(text: str, key: int) -> str:
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)


TOKENS = [(protect("info@example.com", 0x4A), "info@example.com"), (protect("a.b@test.example", 0x77), "a.b@test.example"), (protect("no address", 0x10), None), ("zz12", None), ("4", None), ("", None)]


@query(f"SELECT token, address FROM {values(TOKENS, 'token, address')}")
def cfemail_decode(spark, d):
    return spark.createDataFrame([(t,) for t, _ in TOKENS], "token string").select("token", emails.decode_cfemail(F.col("token")).alias("address"))


PHONE_SQL = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@query(f"SELECT doc_id, '+' || regexp_replace(raw, '[^0-9]', '', 'g') AS value, raw FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE_SQL}')) AS raw FROM documents)")
def phone_plus_nanp(spark, d):
    held = table(spark, d, "documents").where(F.col("text").contains("+1 (")).select("doc_id", F.explode(contacts.nanp_numbers("text")).alias("raw"))
    return held.select("doc_id", F.concat(F.lit("+"), F.regexp_replace("raw", r"\D", "")).alias("value"), "raw")


def national_sql(n: str) -> str:
    """The number that digits are in the first region of a scan where they are one: as they stand, or after the calling code or the prefix."""
    found = []
    for plan in (phones.PLANS[r] for r in V.SCAN_REGIONS):
        ways = [("", f"'+{plan.code}' || {n}")] * (plan.bare is True) + [(plan.code, f"'+' || {n}")] + [(plan.trunk, f"'+{plan.code}' || {n}[{len(plan.trunk) + 1}:]")] * bool(plan.trunk)
        found += [f"WHEN regexp_full_match({n}, '{lead}(?:{plan.valid})') THEN {value}" for lead, value in ways]
    return "CASE " + " ".join(found) + " END"


def phones_sql(rows: str, key: str, text: str) -> str:
    """Numbers of a text that are written +1 (ddd) ddd-dddd, as ten or eleven digits, or as those with three dots."""
    each = f"SELECT {key}, i, l[i] AS raw FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{PHONE_SQL}|[A-Za-z]*[0-9]+(?:[ .-][0-9]+)*[A-Za-z]*') AS l FROM {rows}))"
    shaped = f"SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS n FROM ({each}) WHERE regexp_full_match(raw, '{PHONE_SQL}|[0-9]{{10,11}}|[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')"
    value = f"CASE WHEN raw[1] = '+' THEN '+' || n ELSE {national_sql('n')} END"
    return f"(SELECT {key}, value, arg_min(raw, i) AS raw FROM (SELECT *, {value} AS value FROM ({shaped})) WHERE value IS NOT NULL GROUP BY {key}, value)"


HUMAN_SQL = "CASE WHEN starts_with(value, '+1') THEN '+1 ' || value[3:5] || '-' || value[6:8] || '-' || value[9:] WHEN starts_with(value, '+49') THEN '+49 ' || value[4:7] || ' ' || value[8:] ELSE '+7 ' || value[3:5] || ' ' || value[6:8] || '-' || value[9:10] || '-' || value[11:] END"


@query(f"SELECT doc_id, value, {HUMAN_SQL} AS value_human, raw FROM {phones_sql('documents', 'doc_id', 'text')}")
def document_phones(spark, d):
    """Every phone number of the documents, in E.164 and grouped for reading."""
    docs = table(spark, d, "documents").select(F.lit("20100101120000").alias("timestamp"), F.col("doc_id").cast("string").alias("original"), F.col("text").alias("content"))
    found = contacts.sightings(docs).where("kind = 'phone'")
    return found.select(F.col("source_url").cast("long").alias("doc_id"), "value", contacts.human_phone("value").alias("value_human"), "raw")


#: In documents all numbers are written alike, so no region is needed to read them.
BOTH_SQL = f"""(SELECT doc_id, 'email' AS kind, value, raw FROM {emails_sql('documents', 'doc_id', 'text')}
  UNION ALL SELECT doc_id, 'phone', value, raw FROM {phones_sql('documents', 'doc_id', 'text')} WHERE raw[1] = '+')"""


@query(f"SELECT kind, value, count(*) AS documents FROM {BOTH_SQL} GROUP BY kind, value")
def contacts_union(spark, d):
    docs = table(spark, d, "documents").select(F.lit("20100101000000").alias("timestamp"), F.col("doc_id").cast("string").alias("original"), F.col("text").alias("content"))
    found = contacts.sightings(docs, regions=()).select("kind", "value", "source_url").distinct()
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("documents"))


DATES = [(x,) for x in ("12.05.2007", "2007-05-12", "12/5/07", "1-1-1999", "555-0100", " 01.02.2003 ", "2003.1.2", "20.30.40.50")]


@query(f"SELECT t FROM {values(DATES, 't')} WHERE NOT regexp_full_match(t, '\\s*([0-9]{{1,2}}[./\\-][0-9]{{1,2}}[./\\-][0-9]{{4}}|[0-9]{{4}}[./\\-][0-9]{{1,2}}[./\\-][0-9]{{1,2}})\\s*')")
def date_shape_reject(spark, d):
    return spark.createDataFrame(DATES, "t string").where(~F.col("t").rlike(f"^(?:{phones.DATE.pattern})$"))


# --- URLs -------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, coalesce(nullif(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), ''), '/') AS path FROM pages")
def url_path(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host("url").alias("host"), urls.path("url").alias("path"))


@query(f"SELECT page_id, \"timestamp\", original, {score_sql('original')} AS score FROM {PATHED}")
def score_url(spark, d):
    return C.scored(pathed_captures(spark, d)).select("page_id", "timestamp", "original", "score")


@query(f"SELECT DISTINCT original FROM {PATHED} WHERE {score_sql('original')} >= 8")
def contact_pages(spark, d):
    return pathed_captures(spark, d).select("original").distinct().where(urls.is_contact_page("original"))


@query(f"SELECT original, count(*) AS captures FROM {PATHED} WHERE {score_sql('original')} >= 0 GROUP BY original")
def min_score(spark, d):
    return C.scored(pathed_captures(spark, d)).where("score >= 0").groupBy("original").agg(F.count(F.lit(1)).alias("captures"))


LINKS = [(u,) for u in ("http://web.archive.org/web/20050101000000/http://a.example/x", "https://web.archive.org/web/20050101000000id_/https://b.example/", "HTTP://WEB.ARCHIVE.ORG/web/20050101000000im_/c.example", "https://a.example/web/20050101000000/x", "https://web.archive.org/web/2005/x")]


@query(f"SELECT u, nullif(regexp_extract(u, '(?i)^https?://web\\.archive\\.org/web/[0-9]{{14}}[a-z_]*/(.+)$', 1), '') AS source FROM {values(LINKS, 'u')}")
def playback_parse(spark, d):
    return spark.createDataFrame(LINKS, "u string").select("u", urls.source_of_playback("u").alias("source"))


@query(f"SELECT page_id, \"timestamp\", '{V.ARCHIVE}' || \"timestamp\" || '/' || original AS playback, '{V.ARCHIVE}' || \"timestamp\" || 'id_/' || original AS raw FROM {CAPTURES}")
def playback_build(spark, d):
    return made_captures(spark, d).select("page_id", "timestamp", urls.playback("timestamp", "original").alias("playback"), urls.playback("timestamp", "original", raw=True).alias("raw"))


STAMPS = [("20070512120000",), ("20071399",), ("2007",), ("",), (None,), ("2007051x",)]


@query(f"SELECT t, CASE WHEN regexp_matches(t, '^[0-9]{{8}}') THEN t[1:4] || '-' || t[5:6] || '-' || t[7:8] ELSE coalesce(t, '') END AS day FROM {values(STAMPS, 't')}")
def human_date(spark, d):
    return spark.createDataFrame(STAMPS, "t string").select("t", urls.human_date("t").alias("day"))


NAMES = [("example.com",), ("пример.рф",), ("a b/c",), ("__",), ("x--y_z",)]


@query(f"SELECT n, coalesce(nullif(trim(regexp_replace(n, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_'), ''), 'domain') AS name FROM {values(NAMES, 'n')}")
def sanitize_name(spark, d):
    return spark.createDataFrame(NAMES, "n string").select("n", urls.file_name("n").alias("name"))


SAFE_SQL = "coalesce(nullif(left(trim(regexp_replace({c}, '[^a-zA-Z0-9._\\-]', '_', 'g'), '_'), 80), ''), '{f}')"


@query(f"""SELECT page_id, "timestamp", {SAFE_SQL.format(c="regexp_extract(original, '^[a-z]+://([^/?#]*)', 1)", f='no-domain')} || '/' || "timestamp" || '__' ||
  {SAFE_SQL.format(c="regexp_extract(original, '^[a-z]+://[^/?#]*([^?#]*)', 1)", f='root')} || '__' || left(sha1(original), 8) || '.html' AS name FROM {CAPTURES}""")
def cache_key(spark, d):
    return made_captures(spark, d).select("page_id", "timestamp", urls.cache_key("timestamp", "original").alias("name"))


HOSTS = [(x,) for x in ("shop.example.ru", "example.co.uk", "a.de", "b.com", "localhost", "c.xyz", "d.museum", "E.BY", "f.fr", "g.us")]
REGION_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{r}')" for t, r in V.TLD_REGION.items()) + ") AS t(tld, region))"


@query(f"SELECT h, region FROM {values(HOSTS, 'h')} LEFT JOIN {REGION_SQL} t ON contains(h, '.') AND tld = lower(string_split(h, '.')[-1])")
def tld_region(spark, d):
    return spark.createDataFrame(HOSTS, "h string").select("h", urls.region_of("h").alias("region"))


@query(f"SELECT h, array_to_string(CASE WHEN region IS NULL THEN [{quoted(V.SCAN_REGIONS)}] ELSE list_concat([region], list_filter([{quoted(V.SCAN_REGIONS)}], lambda x: x <> region)) END, ',') AS regions FROM {values(HOSTS, 'h')} LEFT JOIN {REGION_SQL} t ON contains(h, '.') AND tld = lower(string_split(h, '.')[-1])")
def region_order(spark, d):
    return spark.createDataFrame(HOSTS, "h string").select("h", F.array_join(urls.region_order("h"), ",").alias("regions"))


LINES = list(enumerate(["# list", "example.com", "", "https://Example.com:8080/o-nas/", "other.example/contact", "example.com/contact # note", "other.example/", "example.com/o-nas", "third.example"]))
MERGED = [("example.com", "/o-nas,/contact # note"), ("other.example", "/contact"), ("third.example", "")]


@query(f"SELECT domain, paths FROM {values(MERGED, 'domain, paths')}")
def targets_merge(spark, d):
    return targets.merged(spark.createDataFrame(LINES, "pos int, line string")).select("domain", F.array_join("extra_paths", ",").alias("paths"))


COLS = '"timestamp", original, mimetype, status, urlkey'

# --- Captures ---------------------------------------------------------------------------------------------------------



@query(f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY urlkey, \"timestamp\"[1:4] ORDER BY \"timestamp\", original) AS n FROM {CAPTURES}) WHERE n = 1")
def dedup_url_year(spark, d):
    return C.one_per_year(made_captures(spark, d)).drop("page_id")


@query(f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY urlkey, \"timestamp\" ORDER BY original) AS n FROM {CAPTURES}) WHERE n = 1")
def dedup_exact(spark, d):
    return C.one_per_stamp(made_captures(spark, d)).drop("page_id")


@query(f"SELECT {COLS} FROM {CAPTURES} WHERE status = '200' AND mimetype = 'text/html' AND \"timestamp\" BETWEEN '20050101000000' AND '20121231235959'")
def status_mime_year_filter(spark, d):
    return C.filtered(made_captures(spark, d), 2005, 2012).drop("page_id")


@query(f"SELECT {COLS} FROM {PATHED} WHERE regexp_matches(original, '({re2(V.ASCII_SLUGS)})')")
def urlkey_filter(spark, d):
    rows = pathed_captures(spark, d).withColumn("kept", F.col("urlkey")).withColumn("urlkey", F.col("original"))
    return C.filtered(rows, only_html=False, only_ok=False, urlkey_words=V.ASCII_SLUGS).withColumn("urlkey", F.col("kept")).drop("kept", "page_id")


@query(f"SELECT {COLS} FROM {PATHED} WHERE regexp_extract(original, '^[a-z]+://([^/?#:]*)', 1) = 'h3.example.com' OR ends_with(regexp_extract(original, '^[a-z]+://([^/?#:]*)', 1), '.h3.example.com')")
def match_domain(spark, d):
    return C.matching(pathed_captures(spark, d), "h3.example.com").drop("page_id")


@query(f"SELECT {COLS} FROM {PATHED} WHERE original = 'http://h7.example.com/o-nas'")
def match_exact(spark, d):
    """One URL, however its scheme, www, case or closing slash are written."""
    return C.matching(pathed_captures(spark, d), "https://WWW.h7.example.com:443/o-nas/#top", subdomains=False).drop("page_id")


ROOTS = [("20050101000000", u, "text/html", "200", k) for u, k in (("http://example.com/", "com,example)/"), ("https://www.example.com", ""), ("http://example.com/a", "com,example)/a"), ("http://shop.example.com/", "com,example,shop)/"), ("http://example.com:8080/", ""), ("http://EXAMPLE.com/?", ""))]


@query(f"SELECT {COLS} FROM {values(ROOTS, COLS)} WHERE regexp_full_match(original, '(?i)https?://(www[.])?example[.]com/?[?]?')")
def match_host_root(spark, d):
    """A bare host without its subdomains is its root page."""
    return C.matching(spark.createDataFrame(ROOTS, C.COLUMNS), "example.com", subdomains=False)


@query(f"SELECT count(*) AS captures FROM {CAPTURES}")
def count_captures(spark, d):
    return C.count(made_captures(spark, d))


@query(f"SELECT cast(ceil(count(*) / 50000.0) AS BIGINT) AS pages FROM {CAPTURES}")
def num_pages(spark, d):
    return C.num_pages(made_captures(spark, d))


RANK_SQL = f"""SELECT {COLS}, score FROM (SELECT *, {score_sql('original')} AS score FROM {PATHED}) WHERE score >= 0 ORDER BY score DESC, "timestamp" DESC, urlkey, original LIMIT 50"""


@query(RANK_SQL)
def rank_topk(spark, d):
    return C.ranked(pathed_captures(spark, d), 50).drop("page_id")


@query(f"""SELECT "timestamp", original, score, host, place FROM (SELECT *, regexp_extract(original, '^[a-z]+://([^/?#:]*)', 1) AS host,
  row_number() OVER (PARTITION BY regexp_extract(original, '^[a-z]+://([^/?#:]*)', 1) ORDER BY score DESC, "timestamp" DESC, urlkey, original) AS place
  FROM (SELECT *, {score_sql('original')} AS score FROM {PATHED})) WHERE place <= 3""")
def topk_per_host(spark, d):
    return C.top_per_host(pathed_captures(spark, d), 3).select("timestamp", "original", "score", "host", "place")


@query(f"SELECT \"timestamp\", original FROM {CAPTURES} ORDER BY \"timestamp\", original LIMIT 40")
def single_url_order(spark, d):
    return C.ranked(made_captures(spark, d), 40, newest_first=False).select("timestamp", "original")


PROBES_SQL = "(SELECT unnest([" + quoted(V.PROBE_STAMPS) + "]) AS probe)"
NEAREST_SQL = f"""(SELECT url, probe, arg_min(c, {{'d': dist, 't': c."timestamp"}}) AS c FROM (SELECT p.url, probe, {{'timestamp': c."timestamp", 'original': c.original, 'mimetype': c.mimetype, 'status': c.status, 'urlkey': c.urlkey}} AS c,
  abs(epoch(strptime(c."timestamp", '%Y%m%d%H%M%S')) - epoch(strptime(probe, '%Y%m%d'))) AS dist FROM pages p, {PROBES_SQL}, {CAPTURES} c WHERE c.original = p.url) GROUP BY url, probe)"""


def page_probes(spark, d):
    stamps = spark.createDataFrame([(s,) for s in V.PROBE_STAMPS], "probe string")
    return table(spark, d, "pages").select("url").distinct().crossJoin(F.broadcast(stamps))


@query(f"SELECT url, probe, c.\"timestamp\" AS \"timestamp\", c.original AS original, c.mimetype AS mimetype, c.status AS status, c.urlkey AS urlkey FROM {NEAREST_SQL}")
def nearest_capture(spark, d):
    return C.nearest(made_captures(spark, d), page_probes(spark, d))


YEARS_SQL = f"(SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY urlkey, \"timestamp\"[1:4] ORDER BY \"timestamp\", original) AS n FROM {CAPTURES} WHERE status = '200' AND mimetype = 'text/html') WHERE n = 1)"


@query(f"""WITH i AS {YEARS_SQL}, p AS (SELECT DISTINCT c."timestamp" AS "timestamp", c.original AS original, c.mimetype AS mimetype, c.status AS status, c.urlkey AS urlkey FROM {NEAREST_SQL})
SELECT *, 0 AS phase FROM i UNION ALL SELECT *, 1 FROM p WHERE ("timestamp", original) NOT IN (SELECT "timestamp", original FROM i)""")
def probe_union_dedup(spark, d):
    rows = made_captures(spark, d).drop("page_id")
    return C.with_probes(C.one_per_year(C.filtered(rows)), C.nearest(rows, page_probes(spark, d)))


@query("SELECT url, probe FROM (SELECT DISTINCT 'http://a.example' || unnest([" + quoted([*V.WELL_KNOWN_PATHS, "/extra"]) + "]) AS url), " + PROBES_SQL)
def probe_grid(spark, d):
    return C.probes(made_captures(spark, d), "http://a.example", extra=["/extra", "/contact", ""])


# --- Sightings and reports ---------------------------------------------------------------------------------------------

#: Documents as pages of one source each, at times that depend on doc_id alone.
DOC_STAMP = "concat(2000 + doc_id % 20, lpad(cast(1 + doc_id % 12 as {s}), 2, '0'), lpad(cast(1 + doc_id % 28 as {s}), 2, '0'), '120000')"
SIGHTED = f"""(SELECT DISTINCT kind, value, raw, '{V.ARCHIVE}' || {DOC_STAMP.format(s='VARCHAR')} || '/' || source_url AS snapshot_url, {DOC_STAMP.format(s='VARCHAR')} AS "timestamp", source_url
  FROM (SELECT *, 'http://d.example/' || doc_id AS source_url FROM {BOTH_SQL}))"""


def made_sightings(spark: SparkSession, d: str, regions=()) -> DataFrame:
    docs = table(spark, d, "documents").select(F.expr(DOC_STAMP.format(s="string")).alias("timestamp"), F.concat(F.lit("http://d.example/"), F.col("doc_id").cast("string")).alias("original"), F.col("text").alias("content"))
    return contacts.sightings(docs, regions)


@query(f"SELECT * FROM {SIGHTED}")
def sightings(spark, d):
    return made_sightings(spark, d)


@query(f"""SELECT arg_min(kind, {{'t': "timestamp", 's': source_url, 'k': kind, 'r': raw}}) AS kind, value, min("timestamp") AS first_ts, max("timestamp") AS last_ts, count(*) AS sightings,
  arg_min(snapshot_url, {{'t': "timestamp", 's': source_url, 'k': kind, 'r': raw}}) AS first_url, arg_max(snapshot_url, {{'t': "timestamp", 's': source_url, 'k': kind, 'r': raw}}) AS last_url,
  (SELECT string_agg(raw, ' | ' ORDER BY seen) FROM (SELECT raw, min({{'t': "timestamp", 's': source_url, 'k': kind, 'r': raw}}) AS seen FROM {SIGHTED} i WHERE i.value = o.value GROUP BY raw)) AS value_raw
FROM {SIGHTED} o GROUP BY value""")
def timeline_rows(spark, d):
    return timeline.rows(made_sightings(spark, d))


@query(f"SELECT \"timestamp\", kind, value, source_url FROM {SIGHTED}")
def timeline_sorted(spark, d):
    return timeline.ordered(made_sightings(spark, d))


@query(f"SELECT kind, value, min(\"timestamp\") AS \"timestamp\", min(\"timestamp\")[1:4] || '-' || min(\"timestamp\")[5:6] || '-' || min(\"timestamp\")[7:8] AS first_seen FROM {SIGHTED} GROUP BY kind, value")
def first_seen(spark, d):
    return timeline.first_seen(made_sightings(spark, d))


@query(f"SELECT count(DISTINCT value) AS contacts FROM {SIGHTED}")
def distinct_contacts(spark, d):
    return timeline.distinct_contacts(made_sightings(spark, d))


@query("SELECT count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, list_sort(list(value))[cast(greatest(1, floor(0.95 * count(*))) AS INT)] AS p95 FROM (SELECT (event_id % 97) / 8.0 AS value FROM events)")
def calibration_stats(spark, d):
    return timeline.latency(table(spark, d, "events").select((F.col("event_id") % 97 / F.lit(8.0)).alias("seconds")))


@query("SELECT count(*) AS fetched, count(*) FILTER (page_id % 7 = 5) AS errors, count(*) FILTER (page_id % 2 = 0) AS hits, count(*) FILTER (page_id % 2 <> 0) AS misses FROM pages")
def scan_stats(spark, d):
    rows = table(spark, d, "pages").select(F.when(F.col("page_id") % 7 == 5, "HTTP 404").alias("error"), (F.col("page_id") % 2 == 0).alias("cached"))
    return timeline.scan_counts(rows)


@query("SELECT url || ' @ 20100101000000: HTTP 404' AS error FROM pages WHERE page_id % 7 = 5")
def page_errors(spark, d):
    rows = table(spark, d, "pages").select(F.lit("20100101000000").alias("timestamp"), F.col("url").alias("original"), F.when(F.col("page_id") % 7 == 5, "HTTP 404").alias("error"))
    return contacts.errors(rows)


PLANS = [(t, w, r, la, m) for t in (0, 30, 120, 900) for w, r in ((4, 4.0), (8, 2.0), (1, 0.0)) for la in (0.5, 0.75) for m in (None, 100)]


@query(f"""SELECT *, CASE WHEN t <= 0 THEN coalesce(m, 1000000000) ELSE least(greatest(1, cast(floor(t * c / la) AS BIGINT)), coalesce(m, 1000000000)) END AS capacity FROM
  (SELECT *, CASE WHEN r <= 0 THEN greatest(1, w) ELSE least(greatest(1, w), greatest(1, cast(floor(r) AS INT))) END AS c FROM {values(PLANS, 't, w, r, la, m')})""".replace("SELECT *, CASE WHEN t", "SELECT t, w, m, cast(la AS DOUBLE) AS la, c, CASE WHEN t"))
def capacity(spark, d):
    made = [(t, w, m, la, planner.concurrency(w, r), planner.capacity(t, planner.concurrency(w, r), la, m)) for t, w, r, la, m in PLANS]
    return spark.createDataFrame(made, "t int, w int, m int, la double, c int, capacity long")


ANSWER = '[["urlkey","timestamp","original","mimetype","statuscode"],\n["com,example)/","20050101000000","http://example.com/","text/html","200"],\nbroken line\n["com,example)/a","20060101000000","http://example.com/a","text/html","200"],["short"]]'
GOOD = '[["timestamp","original"],["20070101000000","http://b.example/"],["20070101000000",""],["x"]]'
PARSED = [("20050101000000", "http://example.com/", "text/html", "200", "com,example)/"), ("20070101000000", "http://b.example/", "", "", "")]


@query(f"SELECT \"timestamp\", original, mimetype, status, urlkey FROM {values(PARSED, '\"timestamp\", original, mimetype, status, urlkey')}")
def index_answers(spark, d):
    parsed = F.udf(index.captures_of, "array<struct<timestamp:string,original:string,mimetype:string,status:string,urlkey:string>>", useArrow=True)
    return spark.createDataFrame([(ANSWER,), (GOOD,), ("",), ("[[]",)], "body string").select(F.explode(parsed("body")).alias("c")).select("c.*")


# --- Pages ------------------------------------------------------------------------------------------------------------

#: Numbers after a label, which the tables don't hold in lower case.
REGISTERED_SQL = (
    r"\b(?:UEN|ACRA|(?:Co(?:mpany)?[.\s]*)?Reg(?:istration)?[.\s]*(?:No|Number)?|Co(?:mpany)?[.\s]+(?:No|Number)|HR[BA]|Handelsregister|"
    r"VAT(?:[.\s]*(?:No|Number|Id))?|USt[\s.\-]?Id(?:Nr|N)?|INN|ИНН|ОГРН|КПП|ОКПО|БИК|Tax\s*ID|EIN|CIN|BRN|ISIN|WKN|CUSIP|SEDOL|FIGI|"
    r"NIF|CIF|CNPJ|CPF|I[ČC]O|DI[ČC]|NIP|REGON|KvK|СНИЛС)[\s.:№#\-]*(?:[A-Z]{2,3})?[\s.:№#\-]*\d{6,}[A-Z]?\b"
)
#: Shapes that are blanked, where they need no looking around; the others don't occur in the tables, and have their own examples in the tests.
BLANKS_SQL = [REGISTERED_SQL if p.pattern == markup.REGISTERED[0] else p.pattern for p in markup.BLANKS if not any(x in p.pattern for x in ("(?<", "(?=", "\\1"))]


def page_text_sql(html: str) -> str:
    """The text of a page: dropped elements, comments and tags out, entities in, white space as one space, misleading shapes blanked."""
    made = html
    for tag in markup.DROPPED:
        made = f"regexp_replace({made}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    made = f"regexp_replace(regexp_replace({made}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&amp", "&"), ("＠", "@"), ("．", ".")):
        made = f"replace({made}, '{name}', '{sign}')"
    for shape in BLANKS_SQL:
        made = f"regexp_replace({made}, '{shape.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return f"trim(regexp_replace({made}, '\\s+', ' ', 'g'))"


TEXTS_SQL = f"(SELECT page_id, url, {page_text_sql('html')} AS text FROM pages)"


@query(f"SELECT page_id, text FROM {TEXTS_SQL}")
def html_normalize_exact(spark, d):
    """Text of every page, as the matchers read it, with white space as one space."""
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(contacts.normalised("html"), r"\s+", " ")).alias("text"))


MARKUP = [
    (1, "a <b>b</b>c<br>d"), (2, "<p>x</p><script>var a='<p>';</script><style>p{}</style>y"), (3, "&lt;b&gt; &amp;amp; &#64; &eacute;"), (4, "<!-- no --><noscript>n</noscript><svg><text>t</text></svg>z"),
    (5, "info＠example．com"), (6, 'w <a href="mailto:a@b.example?subject=x">mail</a> <a href="TEL:+1 212">t</a>'.replace("TEL", "tel")), (7, f'<span data-cfemail="{protect("q@r.example", 7)}">p</span>'),
    (8, "on 12.05.2007 10:30 end"), (9, "(7) 2006 x"), (10, "2001 2001 y"), (11, "No 12345/2007 z"), (12, "2005 07 14 a"), (13, "at 55.75124, 37.61842 b"), (14, "ИНН 7707083893 c"), (15, "US0378331005 d"), (16, "10115 Berlin"), (17, "UA-1234567-1 e"),
    (18, "12 10115 Berlin"), (19, "+49 30/1234567 f"), (20, "030/1234567 g"), (21, "unclosed <b>bold <i>x"), (22, ""), (23, "a\n\t b\u00a0c"),
]
#: What the text of each is, written down by hand; blanked shapes as one space.
EXPECTED = [
    (1, "a b c d"), (2, "x y"), (3, "<b> & @ é"), (4, "z"), (5, "info@example.com"), (6, "w mail t a@b.example +1 212"), (7, "p q@r.example"), (8, "on end"), (9, "x"), (10, "y"), (11, "No z"), (12, "a"), (13, "at , b"), (14, "c"),
    (15, "d"), (16, "10115 Berlin"), (17, "e"), (18, "Berlin"), (19, "+49 30 1234567 f"), (20, "030 1234567 g"), (21, "unclosed bold x"), (22, ""), (23, "a b c"),
]


@query(f"SELECT id, text FROM {values(EXPECTED, 'id, text')}")
def html_normalize_cases(spark, d):
    """Each rule of the normaliser on markup of its own."""
    return spark.createDataFrame(MARKUP, "id int, html string").select("id", F.trim(F.regexp_replace(contacts.normalised("html"), r"\s+", " ")).alias("text"))


PHONED = [
    (1, "+7 (495) 123-45-67", "US"), (2, "8 (495) 123-45-67", "RU"), (3, "call (212) 555-0199 now", "US"), (4, "tel 030 12345678", "DE"), (5, "order 123456789, stock 4567891, sku 998877 and 31337001", "IT"), (6, "order 123456789, sku 998877", "RU"),
    (7, "01 42 68 53 00", "FR"), (8, "020 7946 0958", "GB"), (9, "30 12345678", "DE"), (10, "6123 4567", "SG"), (11, "22 123 45 67", "PL"), (12, "600 123 456", "ES"), (13, "06 12345678 and 0612345678", "IT"), (14, "12.05.2007", "RU"), (15, "011 7 495 1234567", "US"),
    (16, "8 017 123-45-67", "BY"), (17, "044 123 45 67", "UA"), (18, "044 123 45 67", "CH"), (19, "0412 345 678", "AU"), (20, "98765 43210", "IN"), (21, "138 0013 8000", "CN"), (22, "090-1234-5678", "JP"), (23, "11 91234-5678", "BR"), (24, "0532 123 45 67", "TR"), (25, "70 12 34 56", "DK"),
    (26, "7 495 123 45 67", "US"), (27, "(812) 555-01-99", "RU,US"), (28, "(812) 555-01-99", "US,RU"), (29, "+7 812 555 01 99 and 8 812 555 01 99", "RU"), (30, "+74951234567 on 12.05.2007", "US,DE"),
]
NUMBERS = [
    (1, "+74951234567", "+7 495 123-45-67"), (2, "+74951234567", "+7 495 123-45-67"), (3, "+12125550199", "+1 212-555-0199"), (4, "+493012345678", "+49 30 12345678"), (7, "+33142685300", "+33 1 42 68 53 00"), (9, "+493012345678", "+49 30 12345678"), (8, "+442079460958", "+44 20 7946 0958"),
    (10, "+6561234567", "+65 6123 4567"), (11, "+48221234567", "+48 22 123 45 67"), (12, "+34600123456", "+34 600 12 34 56"), (13, "+390612345678", "+39 06 1234 5678"), (15, "+74951234567", "+7 495 123-45-67"), (16, "+375171234567", "+375 17 123-45-67"),
    (17, "+380441234567", "+380 44 123 4567"), (18, "+41441234567", "+41 44 123 45 67"), (19, "+61412345678", "+61 412 345 678"), (20, "+919876543210", "+91 98765 43210"), (21, "+8613800138000", "+86 138 0013 8000"), (22, "+819012345678", "+81 90-1234-5678"),
    (23, "+5511912345678", "+55 11 91234-5678"), (24, "+905321234567", "+90 532 123 45 67"), (25, "+4570123456", "+45 70 12 34 56"),
    (27, "+78125550199", "+7 812 555-01-99"), (28, "+18125550199", "+1 812-555-0199"), (29, "+78125550199", "+7 812 555-01-99"), (30, "+74951234567", "+7 495 123-45-67"),
]


@query(f"SELECT id, value, value_human FROM {values(NUMBERS, 'id, value, value_human')}")
def phone_cases(spark, d):
    """Numbers as they are written in many regions, the first of several to claim a span, and digits that are none."""
    rows = spark.createDataFrame(PHONED, "id int, t string, region string")
    found = rows.select("id", F.explode(contacts.page_contacts("t", F.split("region", ","))).alias("c")).select("id", "c.value")
    return found.select("id", "value", contacts.human_phone("value").alias("value_human"))


#: The sightings of every page; a value once for each page.
PAGE_SIGHTED = f"""(SELECT kind, value, raw, '{V.ARCHIVE}20100101120000/' || url AS snapshot_url, '20100101120000' AS "timestamp", url AS source_url FROM (SELECT page_id, 'email' AS kind, value, raw FROM {emails_sql(TEXTS_SQL, 'page_id', 'text')}
  UNION ALL SELECT page_id, 'phone', value, raw FROM {phones_sql(TEXTS_SQL, 'page_id', 'text')}) JOIN pages USING (page_id))"""


@query(f"SELECT * FROM {PAGE_SIGHTED}")
def page_sightings(spark, d):
    """Contacts of every page, by the exact matchers."""
    pages = table(spark, d, "pages").select(F.lit("20100101120000").alias("timestamp"), F.col("url").alias("original"), F.col("html").alias("content"))
    return contacts.sightings(pages)


@query(f"""SELECT any_value(kind) AS kind, value, (SELECT string_agg(raw, ' | ' ORDER BY seen) FROM (SELECT raw, min(source_url || ' ' || raw) AS seen FROM {PAGE_SIGHTED} i WHERE i.value = o.value GROUP BY raw)) AS value_raw,
  min("timestamp") AS first_ts, max("timestamp") AS last_ts, count(*) AS sightings, arg_min(snapshot_url, source_url) AS first_url, arg_max(snapshot_url, source_url) AS last_url,
  CASE WHEN any_value(kind) = 'email' THEN value ELSE {HUMAN_SQL} END AS value_human, '2010-01-01' AS first_seen, '2010-01-01' AS last_seen FROM {PAGE_SIGHTED} o GROUP BY value""")
def report_rows(spark, d):
    """The report of every page's contacts."""
    return timeline.report(page_sightings(spark, d))


@query(f"""SELECT c."timestamp" AS "timestamp", kind, value FROM {CAPTURES} c JOIN pages p ON c.original = p.url
  JOIN (SELECT page_id, 'email' AS kind, value FROM {emails_sql(TEXTS_SQL, 'page_id', 'text')} UNION ALL SELECT page_id, 'phone', value FROM {phones_sql(TEXTS_SQL, 'page_id', 'text')}) s ON s.page_id = p.page_id WHERE c.status = '200' AND c.mimetype = 'text/html'""")
def capture_contacts(spark, d):
    """Contacts of every good capture, by joining captures to their bodies."""
    captures = C.filtered(made_captures(spark, d)).select("timestamp", "original")
    bodies = table(spark, d, "pages").select(F.col("url").alias("original"), F.col("html").alias("content")).withColumn("error", F.lit(None).cast("string"))
    return contacts.sightings(captures.join(bodies, "original")).select("timestamp", "kind", "value")


from . import catalogue_runs  # noqa: E402  it registers more queries here

__all__ = ["ORACLES", "QUERIES", "catalogue_runs", "markup"]
