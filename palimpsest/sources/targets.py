"""Targets files: a host or URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def merged(lines: DataFrame) -> DataFrame:
    """domain, extra_paths of lines (pos, line): hosts in order, each with its distinct paths in order."""
    kept = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#")).select("pos", urls.target("line").alias("t"))
    rows = kept.select("pos", "t.*").groupBy("domain").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("pos", "path")))).alias("paths"))
    return rows.select("domain", F.array_distinct(F.transform("paths", lambda p: p["path"])).alias("extra_paths"), "pos")


def parse(line: str) -> tuple[str, str | None]:
    text = line.strip().partition("://")[2] if "://" in line else line.strip()
    name, _, rest = text.partition("/")
    name = name.partition(":")[0].lower()
    if not name:
        raise ValueError(f"empty domain in target line: {line!r}")
    path = ("/" + rest).rstrip("/")
    return name, path or None


def read(path: str) -> list[tuple[str, tuple[str, ...]]]:
    """Targets of a local file; a bad line is named in the error."""
    found: dict[str, dict[str, None]] = {}
    with open(path, encoding="utf-8") as file:
        for n, line in enumerate(file, 1):
            if line.strip() and not line.strip().startswith("#"):
                try:
                    domain, extra = parse(line)
                except ValueError as e:
                    raise ValueError(f"{path}:{n}: {e}") from None
                own = found.setdefault(domain, {})
                if extra:
                    own[extra] = None
    return [(d, tuple(paths)) for d, paths in found.items()]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")))


def well_known(lines: list[str], name: str = "paths") -> tuple[str, ...]:
    """Paths of a list: blank lines and comments skipped, each once."""
    found: dict[str, None] = {}
    for n, line in enumerate(lines, 1):
        line = line.strip()
        if line and not line.startswith("#"):
            if not line.startswith("/"):
                raise ValueError(f"{name}:{n}: entry must start with '/', got {line!r}")
            found[line] = None
    return tuple(found)
