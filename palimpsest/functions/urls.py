"""URL, name and date functions as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(words: list[str]) -> str:
    return "|".join(re.sub(r"([.\-])", r"\\\1", w) for w in words)


def host(url: Column | str) -> Column:
    """Lower-case host without port; null where there is none."""
    found = F.lower(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))
    return F.when(found != "", found)


def path(url: Column | str) -> Column:
    """Percent-decoded path without query, fragment and last parameters; '/' where empty."""
    rest = F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    rest = F.regexp_replace(rest, r";[^/]*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    return F.when(decoded == "", "/").otherwise(decoded)


def score(url: Column | str) -> Column:
    """How likely a URL is a contact page: 5 for the home page, 0 for assets, else 10 for a contact word, -5 for a listing word, 3 for a short path."""
    p = path(url)
    segments = F.filter(F.split(F.lower(p), "/"), lambda s: s != "")
    last = F.element_at(segments, -1)
    high = p.rlike(rf"(?iu)(?:^|[/_\-])(?:{any_of(V.HIGH_SLUGS)})(?:$|[/_.\-])")
    points = F.when(high, 10).otherwise(0) - F.when(F.arrays_overlap(segments, F.array(*map(F.lit, V.LOW_SLUGS))), 5).otherwise(0) + F.when(F.size(segments) <= 2, 3).otherwise(0)
    return F.when(F.size(segments) == 0, 5).when(last.rlike(rf"\.(?:{any_of(V.ASSET_EXTENSIONS)})$"), 0).otherwise(points)


def is_contact_page(url: Column | str) -> Column:
    return score(url) >= 8


def playback(timestamp: Column | str, original: Column | str, raw: bool = False) -> Column:
    """The archive's URL of a capture; raw: as it was stored."""
    return F.concat(F.lit(V.ARCHIVE), _col(timestamp), F.lit("id_/" if raw else "/"), _col(original))


def source_of_playback(url: Column | str) -> Column:
    """The archived URL in a playback URL, else null."""
    found = F.regexp_extract(_col(url), r"(?i)^https?://web\.archive\.org/web/\d{14}[a-z_]*/(.+)$", 1)
    return F.when(found != "", found)


def stamp_seconds(timestamp: Column | str) -> Column:
    """Seconds since 1970 of a timestamp of 4 to 14 digits, the missing ones taken as the earliest; null if it isn't one. Days and hours beyond their range run on."""
    t = F.trim(_col(timestamp))
    whole = F.concat(t, F.substring(F.lit("00010101000000"), F.length(t) + 1, F.lit(14)))
    part = lambda at, n: F.substring(whole, at, n).cast("long")
    month = F.least(F.greatest(part(5, 2), F.lit(1)), F.lit(12)).cast("int")
    days = F.unix_date(F.make_date(F.greatest(part(1, 4), F.lit(1)).cast("int"), month, F.lit(1))) + F.greatest(part(7, 2), F.lit(1)) - 1
    return F.when(t.rlike("^[0-9]{4,14}$"), days * 86400 + part(9, 2) * 3600 + part(11, 2) * 60 + part(13, 2))


def surt(url: Column | str) -> Column:
    """The key an index sorts a URL by: host reversed without www and usual ports, then path and query in lower case; scheme and fragment don't count."""
    u = F.lower(F.regexp_replace(F.trim(_col(url)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", ""))
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^(?:[^/?#@]*@)?([^/?#]*)", 1), r":(?:80|443)?$", ""), r"^www\d{0,3}\.(?=.*\.)", "")
    labels, port = F.split(F.substring_index(name, ":", 1), r"\."), F.regexp_extract(name, r"(:\d+)$", 1)
    rest = F.regexp_extract(u, r"^[^/?#]*(/[^?#]*)", 1)
    rest = F.when(rest == "", "/").otherwise(F.regexp_replace(rest, r"(?<=.)/+$", ""))
    return F.concat(F.array_join(F.reverse(labels), ","), port, F.lit(")"), rest, F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1))


def human_date(timestamp: Column | str) -> Column:
    """YYYY-MM-DD where the first 8 characters are digits, else as it is; null gives ''."""
    t = _col(timestamp)
    day = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    return F.when(t.rlike(r"^[0-9]{8}"), day).otherwise(F.coalesce(t, F.lit("")))


def file_name(name: Column | str, fallback: str = "domain") -> Column:
    made = F.trim(F.regexp_replace(_col(name), r"[^A-Za-z0-9_.\-]+", "_"), F.lit("_"))
    return F.when(made == "", fallback).otherwise(made)


def cache_key(timestamp: Column | str, original: Column | str) -> Column:
    """<host>/<timestamp>__<path>__<first 8 of sha1>.html with unsafe characters replaced."""
    def safe(c: Column, fallback: str) -> Column:
        made = F.substring(F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9._\-]", "_"), F.lit("_")), 1, 80)
        return F.when(made == "", fallback).otherwise(made)

    url = _col(original)
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.concat(safe(netloc, "no-domain"), F.lit("/"), _col(timestamp), F.lit("__"), safe(rest, "root"), F.lit("__"), F.substring(F.sha1(url), 1, 8), F.lit(".html"))


def region_of(domain: Column | str) -> Column:
    """Phone region of a domain's last label, or null."""
    pairs = [F.lit(x) for item in V.TLD_REGION.items() for x in item]
    tld = F.when(_col(domain).contains("."), F.lower(F.substring_index(_col(domain), ".", -1)))
    return F.element_at(F.create_map(*pairs), tld)


def region_order(domain: Column | str, defaults=V.SCAN_REGIONS) -> Column:
    """The domain's own region first, then the defaults, each once."""
    return F.array_distinct(F.filter(F.concat(F.array(region_of(domain)), F.array(*map(F.lit, defaults))), lambda r: r.isNotNull()))


def target(line: Column | str) -> Column:
    """struct(domain, path) of a line of a targets file; a null domain marks a line without a host."""
    s = F.regexp_replace(F.trim(_col(line)), r"^.*?://", "")
    name = F.lower(F.regexp_extract(s, r"^([^/:]*)", 1))
    rest = F.regexp_replace(F.regexp_extract(s, r"^[^/]*(/.*)$", 1), r"/+$", "")
    return F.struct(F.when(name != "", name).alias("domain"), F.when(rest != "", rest).alias("path"))


def single_url_host(url: Column | str) -> Column:
    """Host of an absolute http(s) URL, else null."""
    u = F.trim(_col(url))
    return F.when(F.lower(u).rlike(r"^https?://"), host(u))
