"""The capture index as a DataFrame: Parquet tables, and the archive's JSON answers stored as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("timestamp", "original", "mimetype", "statuscode", "urlkey")


def parse_rows(body: str | None) -> list[list]:
    """Rows of a JSON array of arrays; if it is damaged, of those lines that are arrays, outer brackets peeled."""
    lines = (body or "").splitlines()
    try:
        whole = json.loads("\n".join(lines).strip() or "[]")
        return [r for r in whole if isinstance(r, list)] if isinstance(whole, list) else []
    except json.JSONDecodeError:
        pass
    rows = []
    for line in lines:
        line = line.strip().rstrip(",")
        opens, closes = line.startswith("[["), line.endswith("]]")
        line = line[1:] if opens and not closes else line[:-1] if closes and not opens else line
        try:
            row = json.loads(line)
        except json.JSONDecodeError:
            continue
        if isinstance(row, list) and row:
            rows.append(row)
    return rows


def captures_of(body: str | None) -> list[dict[str, str]]:
    """Captures of an answer: its first row names the fields; rows of another length, or without time or URL, are dropped."""
    rows = parse_rows(body)
    found = [dict(zip(rows[0], r, strict=True)) for r in rows[1:] if len(r) == len(rows[0])] if rows else []
    made = [{"status" if f == "statuscode" else f: str(c.get(f) or "") for f in FIELDS} for c in found]
    return [c for c in made if c["timestamp"] and c["original"]]


def read_answers(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Captures of a folder of stored answers, one file each, or divided by a separator."""

    @F.udf("array<struct<timestamp:string,original:string,mimetype:string,status:string,urlkey:string>>", useArrow=True)
    def parsed(body):
        return captures_of(body)

    texts = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    return texts.select(F.explode(parsed("value")).alias("c")).select("c.*")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures kept as Parquet; filters and columns reach the scan."""
    return spark.read.parquet(path).select("timestamp", "original", "mimetype", "status", "urlkey")


def closest(answer: dict, url: str) -> dict[str, str] | None:
    """The capture in an availability answer, or None."""
    import re

    best = (answer.get("archived_snapshots") or {}).get("closest") or {}
    if not best.get("available") or not best.get("timestamp"):
        return None
    source = re.match(r"(?i)https?://web\.archive\.org/web/\d{14}[a-z_]*/(.+)$", best.get("url") or "")
    return {"timestamp": best["timestamp"], "original": source[1] if source else url, "mimetype": "text/html", "status": str(best.get("status") or "200"), "urlkey": ""}
