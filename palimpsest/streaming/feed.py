"""Pages that land in a folder, extracted as they come."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..functions import vocabulary as V
from ..operators import contacts
from ..sources.pages import PAGES


def landing(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Pages of Parquet files in the order in which they land; a bounded number per batch keeps the reader from running ahead."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sightings(pages: DataFrame, regions=V.SCAN_REGIONS) -> DataFrame:
    return contacts.sightings(pages, regions)


def first_seen(found: DataFrame) -> DataFrame:
    """Each (kind, value) when it first arrives; the state is one key per distinct contact."""
    new = found.dropDuplicates(["kind", "value"])
    return new.select("kind", "value", "timestamp", urls.human_date("timestamp").alias("first_seen"))


def start(found: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; what has been committed survives an interrupt, and a restart goes on from there."""
    writer = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_until(query: StreamingQuery, seconds: float, poll: float = 0.5) -> bool:
    """Whether the query ended by itself; at the deadline it is stopped, its last batch done or not started."""
    until = time.monotonic() + seconds
    while query.isActive and time.monotonic() < until:
        query.awaitTermination(min(poll, max(0.01, until - time.monotonic())))
    if query.isActive:
        query.stop()
        return False
    return True


def stalled(query: StreamingQuery, seconds: float = 20.0) -> bool:
    """Whether the query has reported no progress for so long."""
    last = query.lastProgress
    if not last:
        return False
    from datetime import UTC, datetime

    return (datetime.now(UTC) - datetime.fromisoformat(last["timestamp"].replace("Z", "+00:00"))).total_seconds() > seconds


__all__ = ["F", "first_seen", "landing", "run_until", "sightings", "stalled", "start"]
