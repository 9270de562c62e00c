"""Connected components: tasks shrink their edges to stars; if few are left, one task joins them, else large and small stars alternate, each round written to shared scratch space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Nodes that a task keeps at a time, and edges that one task joins at the end.
NODES, TOGETHER = 1_000_000, 200_000


def _spanning(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the smallest node of each local component: fewer, and fewer rounds. Of NODES nodes at a time."""

    def shrink(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            r = x
            while parent.setdefault(r, r) != r:
                r = parent[r]
            while parent[x] != r:
                parent[x], x = r, parent[x]
            return r

        def stars():
            pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            for i in range(0, len(pairs), 10_000):
                u, v = zip(*pairs[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= NODES:
                yield from stars()
        yield from stars()

    return edges.mapInArrow(shrink, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node in `edges`, two long columns."""
    a, b = edges.columns
    stars = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    spark, begin = edges.sparkSession, common.mark()
    stars, before = common.materialise(_spanning(stars).distinct(), "edges"), None
    few = stars.count() <= TOGETHER
    if few:
        stars = common.materialise(_spanning(stars.coalesce(1)), "edges")
    while not few:
        common.drop_since(spark, begin)  # the rounds before this one
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = common.materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
