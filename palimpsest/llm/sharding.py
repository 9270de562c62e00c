"""Histogram sort: rows in key order, cut into shards of near equal bytes, with one exchange.

Rows are ordered by (doc_id, hash of the text, place in the input): nulls first, and no two rows are alike, so
that a doc_id which a third of all rows share is cut like any other range. Boundaries are found by counting:
each round sends a few probe keys between the bounds known so far, every partition counts rows and bytes below
each probe and notes the least and greatest key between two, and sums of those exact counts narrow the bounds, which are drawn in to keys that exist, until each boundary is within tolerance or between
two neighbouring keys. What reaches the driver is one row per probe. Then rows move once, to the range they are in,
and the counts give each row its gapless slot.

A null text counts no bytes. An empty table gives no rows. A shard may be empty if there are fewer rows than shards.
Other columns of the input are carried on, by any name; key and size must be there, and shard and slot mustn't.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A boundary may miss its share of the bytes by this part of a range's share.
TOLERANCE = 0.001
PROBES = 8
KEY_BYTES = 24
SIGN = -(1 << 63)


def sort_key(doc_id="doc_id", text_hash="text_hash", place="place"):
    """24 bytes in the order of (doc_id with nulls first, text_hash, place)."""

    def ordered(c):
        return F.unhex(F.lpad(F.hex(F.col(c).cast("long").bitwiseXOR(F.lit(SIGN))), 16, "0"))

    return F.concat(F.coalesce(ordered(doc_id), F.unhex(F.lit("0" * 16))), ordered(text_hash), ordered(place))


def count_below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Rows and bytes with a key below each of the sorted probes, and the least and greatest key between neighbouring ones, by the number of probes not above."""
    edges = np.array([p.to_bytes(KEY_BYTES, "big") for p in probes], f"S{KEY_BYTES}")

    def count(batches):
        import pyarrow as pa

        rows, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        ends: dict[int, tuple[bytes, bytes]] = {}
        for batch in batches:
            key = np.array(batch.column(0).to_pylist(), f"S{KEY_BYTES}")
            at = np.searchsorted(edges, key, side="right")
            rows += np.bincount(at, minlength=len(rows))
            size += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), minlength=len(rows)).astype(np.int64)
            order = np.lexsort((key, at))
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            for k, low, high in zip(at[order[first]].tolist(), key[order[first]].tolist(), key[order[np.append(first[1:], len(order)) - 1]].tolist(), strict=True):
                old = ends.get(k, (low, high))
                ends[k] = min(low, old[0]), max(high, old[1])
        held = sorted(ends)
        # numpy drops zero bytes at the end of a key
        column = lambda n: pa.array([ends[k][n].ljust(KEY_BYTES, b"\0") for k in held], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(rows[held]), pa.array(size[held]), column(0), column(1)], ["at", "n", "size", "low", "high"])

    found = keys.select("key", "size").mapInArrow(count, "at int, n long, size long, low binary, high binary").groupBy("at")
    found = found.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in found:
        rows[r["at"]], size[r["at"]] = r["n"], r["size"]
    return np.cumsum(rows)[:-1], np.cumsum(size)[:-1], {r["at"]: (int.from_bytes(r["low"], "big"), int.from_bytes(r["high"], "big")) for r in found}


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[list[int], np.ndarray, int]:
    """parts - 1 boundary keys, the rows below each, and the rows in all. A row belongs to the part after the boundaries not above it."""
    total = keys.agg(F.count(F.lit(1)), F.sum("size"), F.min("key"), F.max("key")).first()
    if not total[0]:
        return [0] * (parts - 1), np.zeros(parts - 1, np.int64), 0
    wanted = [total[1] * i / parts for i in range(1, parts)]
    near = tolerance * total[1] / parts
    low_key, high_key = int.from_bytes(total[2], "big"), int.from_bytes(total[3], "big") + 1
    low = [[low_key, 0, 0] for _ in wanted]  # key, rows and bytes below it
    high = [[high_key, total[0], total[1]] for _ in wanted]
    found: list = [None] * len(wanted)
    while None in found:
        ask = set()
        for i, done in enumerate(found):
            if done is None:
                a, b = low[i][0], high[i][0]
                # Probes around where the bytes would be if they lay evenly between the bounds, and the middle.
                share = (wanted[i] - low[i][2]) / max(1, high[i][2] - low[i][2])
                guess = a + int((b - a) * share)
                for k in range(probes - 1):
                    step = (b - a) >> (2 * (k // 2) + 3)
                    ask.add(min(b - 1, max(a + 1, guess + (step if k % 2 else -step))))
                ask.add((a + b) // 2)
        ask = sorted(ask)
        rows, size, ends = count_below(keys, ask)
        for i, done in enumerate(found):
            if done is not None:
                continue
            for key, n, s in zip(ask, rows.tolist(), size.tolist(), strict=True):
                if low[i][0] < key and s <= wanted[i]:
                    low[i] = [key, n, s]
                if s > wanted[i] and key < high[i][0]:
                    high[i] = [key, n, s]
            # Draw the bounds in to the keys that there are between them.
            between = ends.get(bisect_right(ask, low[i][0]))
            if between and between[0] > low[i][0]:
                low[i] = [between[0], *low[i][1:]]
            if between and low[i][0] <= between[1] < high[i][0] - 1:
                high[i] = [between[1] + 1, *high[i][1:]]
            best = min(low[i], high[i], key=lambda x: abs(x[2] - wanted[i]))
            if abs(best[2] - wanted[i]) <= near or high[i][1] - low[i][1] <= 1 or high[i][0] - low[i][0] <= 1:
                found[i] = best
    found.sort()
    return [x[0] for x in found], np.array([x[1] for x in found], np.int64), total[0]


def shard(rows: DataFrame, shards: int, ranges: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """rows (with key, size and any others) with shard and slot added.

    Each shard is cut into `ranges` further ranges, so that sorting and numbering never need a whole shard in one task.
    """
    spark = rows.sparkSession
    ranges = ranges or max(1, -(-common.partitions(spark) // shards))
    cuts, below, _ = splitters(rows, shards * ranges, tolerance)
    edges = np.array([c.to_bytes(KEY_BYTES, "big") for c in cuts], f"S{KEY_BYTES}")
    base = [0, *below.tolist()]
    first = [base[i // ranges * ranges] for i in range(shards * ranges)]

    def range_of(key):
        return pd.Series(np.searchsorted(edges, np.array(key.tolist(), f"S{KEY_BYTES}"), side="right").astype(np.int32))

    range_of = F.pandas_udf(range_of, "int", F.PandasUDFType.SCALAR)
    part, place, first_slot = (common.fresh(rows, name) for name in ("__range", "__place", "__base"))
    info = spark.createDataFrame([(i, i // ranges, base[i] - first[i]) for i in range(shards * ranges)], f"{part} int, shard int, {first_slot} long")
    dealt = rows.withColumn(part, range_of("key")).repartitionById(shards * ranges, F.col(part))
    number = F.row_number().over(Window.partitionBy(part).orderBy("key"))
    numbered = dealt.withColumn(place, number).join(F.broadcast(info), part)
    return numbered.withColumn("slot", (F.col(first_slot) + F.col(place) - 1).cast("long")).drop(part, first_slot, place)


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards in doc_id order, cut as near to equal bytes as whole rows allow."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    text = common.text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    rows = common.materialise(rows.select("doc_id", "size", "text_crc32", sort_key().alias("key")), "shard-keys")
    return shard(rows, 8, tolerance=0.0).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """What each byte adds to a CRC-32, from its polynomial."""
    found = list(range(256))
    for _ in range(8):
        found = [c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1 for c in found]
    return found


#: CRC-32 of a text, byte by byte over its hex digits.
CRC_SQL = f"""xor(4294967295::BIGINT, list_reduce(list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), ','), lambda h: CASE WHEN h = '' THEN -1 ELSE ('0x' || h)::BIGINT END),
  lambda c, b: CASE WHEN b < 0 THEN c ELSE xor(c >> 8, (CAST({_crc_table()} AS BIGINT[]))[(xor(c, b) & 255) + 1]) END, 4294967295::BIGINT))"""
#: For tables in which no two rows share a doc_id.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {CRC_SQL} AS text_crc32 FROM documents),
  o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS n, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
  c AS (SELECT k, arg_min(n, abs(8 * upto - k * total) * 10000000000 + n) AS below FROM (SELECT n, upto, total FROM o UNION ALL SELECT DISTINCT 0, 0, total FROM o), (SELECT unnest(range(1, 8)) AS k) GROUP BY k)
SELECT doc_id, cast(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, cast((SELECT count(*) FROM c WHERE below < n) AS INT) AS shard, cast(n - 1 - coalesce((SELECT max(below) FROM c WHERE below < n), 0) AS BIGINT) AS slot, cast(NULL AS INT) AS grown_shard FROM o
"""
