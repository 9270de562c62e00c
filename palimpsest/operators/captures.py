"""Operators over captures: timestamp, original, mimetype, status, urlkey, all strings; narrow, and partitioned by the source.

Ties have an order of their own, (urlkey or original, timestamp, original), so results don't depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import vocabulary as V

COLUMNS = "timestamp string, original string, mimetype string, status string, urlkey string"
PAGE_ROWS = 50_000


def key() -> Column:
    return F.coalesce(F.when(F.col("urlkey") != "", F.col("urlkey")), F.col("original"))


def matching(captures: DataFrame, target: str, subdomains: bool = True) -> DataFrame:
    """Captures of a host with all its subdomains, or of exactly one URL; a bare host is its own root then.

    One URL is one index key: scheme, www and a closing slash don't count. The key is a literal, so the scan can skip row groups by it.
    """
    if not subdomains:
        wanted = captures.sparkSession.range(1).select(urls.surt(F.lit(target))).first()[0]
        return captures.where((F.col("urlkey") == wanted) | (~F.coalesce(F.col("urlkey").contains(")"), F.lit(False)) & (urls.surt("original") == wanted)))
    host = urls.host("original")
    return captures.where((host == target) | host.endswith("." + target))


def filtered(captures: DataFrame, from_year: int | None = None, to_year: int | None = None, only_html: bool = True, only_ok: bool = True, urlkey_words: list[str] | None = None) -> DataFrame:
    """Comparisons with literals, which the scan can skip row groups by."""
    if only_ok:
        captures = captures.where(F.col("status") == "200")
    if only_html:
        captures = captures.where(F.col("mimetype") == "text/html")
    if from_year is not None:
        captures = captures.where(F.col("timestamp") >= f"{from_year:04d}0101000000")
    if to_year is not None:
        captures = captures.where(F.col("timestamp") <= f"{to_year:04d}1231235959")
    return captures.where(F.col("urlkey").rlike(urls.any_of(urlkey_words))) if urlkey_words else captures


def _first_of(captures: DataFrame, *by: Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("timestamp", "original")
    return captures.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def one_per_year(captures: DataFrame) -> DataFrame:
    """The first capture of each URL in each year."""
    return _first_of(captures, key(), F.substring("timestamp", 1, 4))


def one_per_stamp(captures: DataFrame) -> DataFrame:
    return _first_of(captures, key(), F.col("timestamp"))


def scored(captures: DataFrame) -> DataFrame:
    return captures.withColumn("score", urls.score("original"))


def ranked(captures: DataFrame, capacity: int | None, min_score: int = 0, newest_first: bool = True) -> DataFrame:
    """The best captures, at most `capacity`; `newest_first` false: in order of time, whatever their score (a single URL)."""
    if newest_first:
        order = [F.desc("score"), F.desc("timestamp"), key(), F.col("original")]
        captures = scored(captures).where(F.col("score") >= min_score).orderBy(*order)
    else:
        captures = captures.orderBy("timestamp", "original")
    return captures if capacity is None else captures.limit(capacity)


def top_per_host(captures: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("host").orderBy(F.desc("score"), F.desc("timestamp"), key(), "original")
    return scored(captures).withColumn("host", urls.host("original")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def oversampled(captures: DataFrame, limit: int | None) -> DataFrame:
    """What the index returns before ranking: its first `limit` rows in its own order."""
    return captures if limit is None else captures.orderBy(key(), "timestamp", "original").limit(limit)


def count(captures: DataFrame) -> DataFrame:
    return captures.agg(F.count(F.lit(1)).alias("captures"))


def num_pages(captures: DataFrame) -> DataFrame:
    return captures.agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("long").alias("pages"))


def probes(captures: DataFrame, base: str, paths=V.WELL_KNOWN_PATHS, extra=(), stamps=V.PROBE_STAMPS) -> DataFrame:
    """url, probe of every well-known or extra path at every probe time; a fixed, small table."""
    spark = captures.sparkSession
    listed = list(dict.fromkeys([*paths, *(p for p in extra if p)]))
    return spark.createDataFrame([(base + p, s) for p in listed for s in stamps], "url string, probe string")


def nearest(captures: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (url, probe) in `asked`, the capture of that URL nearest in time; the earlier of two. URLs without any drop out.

    Between two neighbouring probes only the first and the last capture can be nearest to any, so captures are first reduced to those, by URL and
    interval, as they are read: a URL with many captures sends few. `asked` is broadcast where its size allows, by the optimiser.
    """
    row = F.struct("timestamp", "original", "mimetype", "status", "urlkey")
    grid = asked.select("url", "probe", urls.stamp_seconds("probe").alias("asked_at")).where("asked_at is not null").distinct()
    stops = grid.groupBy("url").agg(F.collect_set("asked_at").alias("stops"))
    timed = captures.select(F.col("original").alias("url"), urls.stamp_seconds("timestamp").alias("at"), row.alias("c")).where("at is not null")
    between = timed.join(stops, "url").select("url", "at", "c", F.size(F.filter("stops", lambda s: s <= F.col("at"))).alias("interval"))
    ends = between.groupBy("url", "interval").agg(F.min(F.struct("at", "c")).alias("first"), F.min(F.struct((-F.col("at")).alias("at"), "c")).alias("last"))
    both = ends.select("url", F.explode(F.array("first.c", "last.c")).alias("c")).select("url", "c", urls.stamp_seconds("c.timestamp").alias("at"))
    best = F.min(F.struct(F.abs(F.col("at") - F.col("asked_at")).alias("distance"), "c"))
    return both.join(grid, "url").groupBy("url", "probe").agg(best.alias("best")).select("url", "probe", "best.c.*")


def needed(found: DataFrame) -> DataFrame:
    """Of answered probes (url, probe, timestamp), asked in turn, those that had to be asked: nothing new lies between a probe and its answer, so a later probe there needs no asking.

    A URL has a handful of probes, which are folded in order.
    """
    each = F.struct(urls.stamp_seconds("probe").alias("asked"), urls.stamp_seconds("timestamp").alias("hit"), "probe", "timestamp")
    turns = found.groupBy("url").agg(F.sort_array(F.collect_list(each)).alias("turns"))
    none = F.filter("turns", lambda t: F.lit(False))
    covered = lambda kept, t: F.exists(kept, lambda k: t["asked"].between(F.least(k["asked"], k["hit"]), F.greatest(k["asked"], k["hit"])))
    kept = F.aggregate("turns", none, lambda kept, t: F.when(covered(kept, t), kept).otherwise(F.concat(kept, F.array(t))))
    return turns.select("url", F.explode(kept).alias("k")).select("url", "k.probe", "k.timestamp")


def with_probes(index: DataFrame, probed: DataFrame, capacity: int | None = None) -> DataFrame:
    """Ranked index rows, then probe hits not among them, each (timestamp, original) once, under one capacity; phase says which."""
    columns = ["timestamp", "original", "mimetype", "status", "urlkey"]
    rest = probed.select(*columns).dropDuplicates(["timestamp", "original"]).join(index.select("timestamp", "original"), ["timestamp", "original"], "left_anti")
    both = index.select(*columns, F.lit(0).alias("phase")).unionByName(rest.select(*columns, F.lit(1).alias("phase")))
    return both if capacity is None else both.orderBy("phase", F.desc("timestamp"), "original").limit(capacity)
