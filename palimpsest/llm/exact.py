"""Exact duplicates by a log-structured merge index of digests; DataFrame functions only.

Texts are equal when identical after each run of ASCII white space becomes one space. A batch is a memtable per
task: its digests, sorted, are flushed as a run, with a filter of its members: a bitmap by hash, in pages of 4 kB. Compaction merges runs into
one sorted level that keeps, per digest, the smallest identifier and the number of rows, and writes a second filter, of the digests
that occur more than once; partial sums before the exchange keep a hot digest small. Rows are tested against a filter where they are read (it is sent to
all tasks, FILTER_BITS at most), and only those that it lets through move to probe the level: texts that occur once never do, but
for a few that share a bit. Every hit is compared byte by byte with the text
of the row that stays; that text is repeated once per SALT_ROWS hits, which are dealt by their place in the input, so a group of any size spreads over tasks.
The probe itself is an inner join with one row per digest, of which adaptive execution splits hot digests.
Digests of which a hit fails are resolved by the texts themselves, so results don't rest on the digest.

Nulls: a null text is empty; a null doc_id is above all others, and rows of a group without any id keep one of them.
Rows that repeat both text and smallest doc_id: the first in the input stays. Other columns are carried only by `survivors`.
An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WHITE = r"[\x20\x09-\x0D]+"
#: Hits that share one copy of the text they are compared with.
SALT_ROWS = 4096
#: Bits of a filter for each member, and at most: 16 MB.
BITS_EACH, FILTER_BITS = 16, 1 << 27
PAGE_BITS = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def _bit(bits: int) -> Column:
    """The bit of a digest in a filter, from 1."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


class LsmIndex:
    """digest -> smallest doc_id, where that row stands, and number of rows, in a folder of sorted runs."""

    RUN = "digest long, doc_id long, place long, n long"
    FILTER = "page long, bitmap binary"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.scratch_path(spark, "digests")
        self.runs: list[str] = []
        #: Path and bits of each run's filter of members, and of the level's filter of repeated digests.
        self.members: list[tuple[str, int]] = []
        self.repeated: tuple[str, int] | None = None

    def _write(self, rows: DataFrame, level: int) -> str:
        path = f"{self.path}/level{level}-{uuid.uuid4().hex}"
        rows.select("digest", "doc_id", "place", "n").sortWithinPartitions("digest", "doc_id").write.parquet(path)
        return path

    def _write_filter(self, rows: DataFrame, count: int) -> tuple[str, int]:
        bits = PAGE_BITS
        while bits < min(FILTER_BITS, BITS_EACH * count):
            bits *= 2
        path = f"{self.path}/filter-{uuid.uuid4().hex}"
        made = rows.groupBy(F.bitmap_bucket_number(_bit(bits)).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(bits))).alias("bitmap"))
        made.write.parquet(path)
        return path, bits

    def flush(self, rows: DataFrame) -> None:
        """Add a batch (digest, doc_id, place): each task sorts its own and writes it."""
        self.runs.append(self._write(rows.select("digest", "doc_id", "place", F.lit(1).cast("long").alias("n")), 0))
        run = self.spark.read.schema(self.RUN).parquet(self.runs[-1])
        self.members.append(self._write_filter(run, run.count()))

    def compact(self) -> None:
        """Merge all runs into one, with a row per digest."""
        old = self.runs + [path for path, _ in self.members] + ([self.repeated[0]] if self.repeated else [])
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
        merged = self.read().groupBy("digest").agg(least.alias("first"), F.sum("n").alias("n")).select("digest", "first.doc_id", "first.place", "n")
        self.runs = [self._write(merged, 1)]
        level = self.read()
        count, again = level.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
        self.members, self.repeated = [self._write_filter(level, count)], self._write_filter(level.where("n > 1"), again)
        for path in old:
            common.drop_scratch(self.spark, path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.RUN).parquet(*self.runs)

    def _let_through(self, rows: DataFrame, path: str, bits: int) -> DataFrame:
        """rows with __in: whether a filter holds their digest, or another one of the same bit."""
        pages = self.spark.read.schema(self.FILTER).parquet(path).select(F.col("page").alias("__page"), F.col("bitmap").alias("__bitmap"))
        joined = rows.join(F.broadcast(pages), F.bitmap_bucket_number(_bit(bits)) == F.col("__page"), "left")
        place = F.bitmap_bit_position(_bit(bits))
        byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = F.expr("shiftright(__byte, cast(__at as int)) & 1") == 1
        return joined.withColumn("__byte", byte).withColumn("__at", place % 8).withColumn("__in", F.coalesce(held, F.lit(False))).drop("__page", "__bitmap", "__byte", "__at")

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """rows with __in: whether any run may hold their digest."""
        found = rows.withColumn("__any", F.lit(False))
        for path, bits in self.members:
            found = self._let_through(found, path, bits).withColumn("__any", F.col("__any") | F.col("__in")).drop("__in")
        return found.withColumnRenamed("__any", "__in")

    def may_repeat(self, rows: DataFrame) -> DataFrame:
        """rows with __in: whether their digest may occur more than once; after compact()."""
        return self._let_through(rows, *self.repeated)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows whose digest the index holds, with keep_id, keep_place and group_size; after compact(). Filter them first."""
        level = self.read().select("digest", F.col("doc_id").alias("keep_id"), F.col("place").alias("keep_place"), F.col("n").alias("group_size"))
        return rows.join(level, "digest")


def resolve(docs: DataFrame, carry: bool = False, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row, and with `carry` the row itself as __row."""
    norm = normalised(common.text_of())
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.struct("text")
    batch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(norm).cast("long").alias("digest"), F.sha2(norm, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("place"), row.alias("__row"))
    batch = common.materialise(batch, "batch")  # a row's place must not change from here on
    index = LsmIndex(docs.sparkSession)
    index.flush(batch)
    index.compact()
    rows = index.may_repeat(batch)
    carried = ["__row"] * carry
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *carried]
    once = rows.where("not __in").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *carried)
    probed = common.materialise(index.lookup(rows.where("__in").drop("__in")).withColumn("norm", F.when(F.col("group_size") > 1, normalised(common.text_of(F.col("__row.text"))))), "probed")

    # Verification: every hit against the text of the row that stays.
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    hits = probed.where("group_size > 1").select("digest", "norm", "place", "keep_place", "group_size")
    texts = hits.where("place = keep_place").select("digest", F.col("norm").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = hits.where("place <> keep_place").select("digest", "norm", F.pmod(F.xxhash64("place"), salts).cast("int").alias("salt"))
    failed = common.materialise(salted.join(texts, ["digest", "salt"]).where("norm <> kept_text").select("digest").distinct(), "collisions")
    settled = probed
    if not failed.isEmpty():
        apart = probed.join(failed, "digest", "left_semi").drop("keep_id", "keep_place", "group_size")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
        by_text = apart.groupBy("digest", "norm").agg(least.alias("first"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.select("digest", "norm", F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("keep_place"), "group_size")
        settled = probed.join(failed, "digest", "left_anti").unionByName(apart.join(by_text, ["digest", "norm"]))
    return once.unionByName(settled.withColumn("kept", F.col("place") == F.col("keep_place")).select(*columns))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return resolve(docs, carry=True).where("kept").select("__row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return resolve(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return survivors(docs)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
