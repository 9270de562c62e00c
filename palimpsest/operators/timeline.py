"""Aggregates over sightings. Sums and extremes combine before the exchange; only a contact's distinct literal forms are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

ORDER = ["timestamp", "source_url", "kind", "raw"]


def rows(sightings: DataFrame) -> DataFrame:
    """A row per value: kind of its first sighting, distinct literal forms in order of appearance, first and last sighting, their number."""
    # One row per value and literal form first: a contact seen on every page keeps few.
    forms = sightings.groupBy("value", F.trim(F.coalesce("raw", F.lit(""))).alias("form")).agg(
        F.min(F.struct(*ORDER, "snapshot_url")).alias("first"), F.max(F.struct(*ORDER, "snapshot_url")).alias("last"), F.count(F.lit(1)).alias("n")
    )
    made = forms.groupBy("value").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("sightings"), F.array_sort(F.collect_list(F.struct("first", "form"))).alias("forms"))
    return made.select(
        F.col("first.kind").alias("kind"), "value", F.array_join(F.filter(F.transform("forms", lambda f: f["form"]), lambda f: f != ""), " | ").alias("value_raw"),
        F.col("first.timestamp").alias("first_ts"), F.col("last.timestamp").alias("last_ts"), "sightings", F.col("first.snapshot_url").alias("first_url"), F.col("last.snapshot_url").alias("last_url"),
    )


def report(sightings: DataFrame) -> DataFrame:
    """rows() with phones grouped for reading and dates, in the order of a report."""
    from .contacts import human_phone

    made = rows(sightings).withColumn("value_human", F.when(F.col("kind") == "phone", human_phone("value")).otherwise(F.col("value")))
    made = made.withColumn("first_seen", urls.human_date("first_ts")).withColumn("last_seen", urls.human_date("last_ts"))
    return made.orderBy("first_ts", "kind", "value")


def ordered(sightings: DataFrame) -> DataFrame:
    return sightings.select("timestamp", "kind", "value", "source_url").orderBy("timestamp", "kind", "value", "source_url")


def first_seen(sightings: DataFrame) -> DataFrame:
    """The first sighting of each contact, with its date."""
    return sightings.groupBy("kind", "value").agg(F.min("timestamp").alias("timestamp")).withColumn("first_seen", urls.human_date("timestamp"))


def distinct_contacts(sightings: DataFrame) -> DataFrame:
    return sightings.agg(F.countDistinct("value").alias("contacts"))


def latency(samples: DataFrame, column: str = "seconds", least: int = 4, fallback: float = 0.6) -> DataFrame:
    """n, mean, median and the 95th percentile by the lower rank; the fallback where there are too few samples.

    Quantiles are read off a cumulative count of the distinct values, so no task ever holds the samples; the median is the mean of the two in the middle.
    """
    value = F.col(column).cast("double").alias("value")
    by_value = samples.where(F.col(column).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("times"))
    totals = by_value.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), (F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"))
    n = F.col("n")
    ranks = F.array(F.floor((n + 1) / 2), F.floor((n + 2) / 2), F.greatest(F.lit(1), F.floor(n * 0.95)))
    asked = totals.select("n", "mean", F.posexplode(ranks).alias("which", "rank"))
    # Exact counts up to each value, in two levels: within a range of values, then of the ranges before it.
    ranges = max(1, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = by_value.repartitionByRange(ranges, "value").select("value", "times", F.spark_partition_id().alias("slot"))
    before = ordered.groupBy("slot").agg(F.sum("times").alias("all")).select("slot", (F.sum("all").over(Window.orderBy("slot")) - F.col("all")).alias("before"))
    counted = ordered.withColumn("up_to", F.sum("times").over(Window.partitionBy("slot").orderBy("value"))).join(F.broadcast(before), "slot").withColumn("up_to", F.col("up_to") + F.col("before"))
    hit = counted.join(F.broadcast(asked.select("which", "rank")), (F.col("rank") > F.col("up_to") - F.col("times")) & (F.col("rank") <= F.col("up_to")))
    both = hit.select("which", "value").unionByName(totals, allowMissingColumns=True)
    pick = lambda x: F.when(F.max("n") >= least, x).otherwise(F.lit(fallback))
    at = lambda k: F.max(F.when(F.col("which") == k, F.col("value")))
    return both.agg(F.max("n").alias("n"), pick(F.max("mean")).alias("mean"), pick((at(0) + at(1)) / 2).alias("median"), pick(at(2)).alias("p95"))


def scan_counts(pages: DataFrame, cached: str = "cached") -> DataFrame:
    """Pages fetched, those with an error, and cache hits and misses."""
    hit = F.col(cached) if cached in pages.columns else F.lit(False)
    return pages.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
