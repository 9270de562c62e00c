"""What the corpus operators share: tables, scratch space and tokenisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe

END_ID = 2
_own_scratch: list[str] = []
#: Scratch paths of this process, in the order in which they were named.
_named: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of its own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_scratch:
            _own_scratch.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
        base = _own_scratch[0]
    return f"{base.rstrip('/')}/palimpsest/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    _named.append(f"{scratch(spark)}/{label}-{uuid.uuid4().hex}")
    return _named[-1]


#: Whether Spark removes what a query has shuffled when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df to shared scratch space and read it back: cuts lineage, survives lost executors.

    If `free`, what was shuffled for it goes at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Remove one scratch table, or all of this application's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path or scratch(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A point in the order of scratch paths, for drop_since()."""
    return len(_named)


def drop_since(spark: SparkSession, begin: int, keep: int = 1) -> None:
    """Remove the scratch tables named since a mark, but the last `keep`: once a result is written, what led to it isn't read again."""
    for path in _named[begin : len(_named) - keep]:
        drop_scratch(spark, path)
    del _named[begin : len(_named) - keep]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def vocabulary_size(path: str) -> int:
    return wordbpe.of(path).size


def narrow(path: str) -> str:
    """The smallest type that holds every id."""
    return wordbpe.of(path).kind.str


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(texts, tokenizer: str):
    """Ids of whole texts (an Arrow string column; null counts as empty), each with the end id, and where each text's begin and the last's end."""
    import pyarrow as pa

    return wordbpe.of(tokenizer).encode(texts.cast(pa.string()).fill_null(""), END_ID)


def binary_rows(flat, at):
    """An Arrow binary column of the runs of an array."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def runs_of(column, kind: str):
    """The reverse: the array whose runs an Arrow binary column holds, and where each begins and the last ends. Not copied."""
    import numpy as np
    import pyarrow as pa

    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data, size = column.buffers()[2], np.dtype(kind).itemsize
    flat = np.frombuffer(data, kind, int(at[-1] - at[0]) // size, int(at[0])) if data is not None else np.zeros(0, kind)
    return flat, (at - at[0]) // size


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch, rows: int = 256):
    """An Arrow batch in pieces of so many rows, so that Python objects of few texts exist at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def slices_of_bytes(batch, column: int, most: int = 8 << 20):
    """An Arrow batch in pieces whose texts in one column have so many bytes together, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    end = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = int(end[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(end, before + most, side="right")))
        yield batch.slice(low, high - low)
        low = high
