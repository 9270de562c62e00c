"""Page bodies: a cache table, and a source that fetches what the cache lacks."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

RETRIED = frozenset({404, 408, 429, 500, 502, 503, 504})
PAGES = "timestamp string, original string, status int, content string, error string"
#: url -> (status, content type, body)
Get = Callable[[str], tuple[int, str, str]]


def default_folder(spark: SparkSession) -> str:
    """The folder that PALIMPSEST_CACHE_DIR names, or one in the user's own cache; that one is no use to other machines, so only in local mode."""
    own, shared = os.environ.get("PALIMPSEST_CACHE_DIR"), os.environ.get("XDG_CACHE_HOME")
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share, by --cache or PALIMPSEST_CACHE_DIR")
    return own or f"file://{Path(shared or Path.home() / '.cache').absolute() / 'palimpsest' / 'pages'}"


class PageCache:
    """Pages by (timestamp, original), as Parquet; the writer's commit makes each addition whole or nothing."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or default_folder(spark)

    def _hadoop(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self) -> DataFrame:
        fs, p = self._hadoop()
        kind = f"{PAGES}, name string"
        return self.spark.read.schema(kind).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], kind)

    def get(self, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits with their pages, and the captures that have none."""
        kept = self.read().dropDuplicates(["timestamp", "original"]).drop("name")
        return captures.join(kept, ["timestamp", "original"]), captures.join(kept.select("timestamp", "original"), ["timestamp", "original"], "left_anti")

    def put(self, pages: DataFrame) -> None:
        """Add good, non-empty pages."""
        good = pages.where("error is null and status = 200 and content <> ''")
        good.select("timestamp", "original", "status", "content", "error", urls.cache_key("timestamp", "original").alias("name")).write.mode("append").parquet(self.path)

    def size(self) -> int:
        return self.read().select("timestamp", "original").distinct().count()

    def clear(self) -> int:
        n, (fs, p) = self.size(), self._hadoop()
        fs.delete(p, True)
        return n

    def close(self) -> None:
        """Nothing is held open."""


def http_get(url: str, seconds: float = 30.0, agent: str = "palimpsest") -> tuple[int, str, str]:
    """status, content type, body of a URL; an answer that isn't a page is no exception."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
            kind = answer.headers.get("Content-Type") or ""
            return answer.status, kind, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return e.code, e.headers.get("Content-Type") or "", ""


def fetch_one(get: Get, url: str, retries: int = 3, sleep=time.sleep) -> tuple[int, str, str | None]:
    """status, content, error of a page; transient failures are tried again after a pause that grows."""
    status, error = 0, "not tried"
    for attempt in range(1, max(1, retries) + 1):
        try:
            status, kind, body = get(url)
        except Exception as e:
            status, error = 0, f"{type(e).__name__}: {e}"
        else:
            if status == 200:
                text = not kind or "html" in kind or "text" in kind
                return (200, body, None) if text else (200, "", f"non-html: {kind}")
            error = f"HTTP {status}"
            if status not in RETRIED:
                break
        if attempt < retries:
            sleep((3.0 if status == 404 else 1.5) * attempt)
    return status, "", error


def fetch(captures: DataFrame, get: Get, workers: int = 4, rate: float = 4.0, retries: int = 3, seconds: float | None = None) -> DataFrame:
    """Pages of captures. Each of `workers` tasks keeps its share of the rate; after `seconds` a task starts no other page."""
    pause = workers / rate if rate and rate > 0 else 0.0
    until = None if seconds is None else time.time() + seconds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            rows = []
            for c in batch.itertuples():
                if until is not None and time.time() >= until:
                    break
                time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                rows.append((c.timestamp, c.original, *fetch_one(get, c.url, retries)))
            yield pd.DataFrame(rows, columns=["timestamp", "original", "status", "content", "error"])

    asked = captures.select("timestamp", "original", urls.playback("timestamp", "original", raw=True).alias("url"))
    return asked.repartition(workers).mapInPandas(run, PAGES)


def load(captures: DataFrame, cache: PageCache | None, get: Get | None, **options) -> DataFrame:
    """Pages of captures: cached ones first, the rest fetched and kept; `cached` says which."""
    if cache is None:
        return fetch(captures, get, **options).withColumn("cached", F.lit(False))
    hits, missing = cache.get(captures.select("timestamp", "original"))
    hits = hits.withColumn("cached", F.lit(True))
    if get is None:
        return hits
    new = fetch(missing, get, **options).persist()
    cache.put(new)
    return hits.unionByName(new.withColumn("cached", F.lit(False)))
