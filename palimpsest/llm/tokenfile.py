"""Token ids as canonical, length-limited Huffman code in independent blocks.

File format, a folder of two tables that any Spark reader can open:

``codebook``  symbol, length: the canonical code (by length, then symbol), none longer than LIMIT bits.
``blocks``    one row per block of whole documents: ``part`` and ``block`` give the order, ``inside`` the ids before it
              in its part, ``doc_ids`` and ``doc_tokens`` the documents, ``n_tokens`` their ids, ``bits`` the code words, high bit first, and
              ``checkpoints`` the bit offset of every STEP-th id as little-endian unsigned 64-bit integers.

Blocks decode alone: a lost task rewrites only its own, and a reader may start at any checkpoint.
Ids are kept in ascending doc_id order, null ids first; rows that share an id are ordered by the first HEAD bytes of their ids, a hash of
all of them and their place in the input, so that an id which a third of all rows share is cut over many parts like any other range.
A null text counts as empty and is its end id alone. An empty table gives an empty file. Columns other than
doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordbpe

LIMIT = 18
STEP = 64
BLOCK_TOKENS = 1 << 18
HEAD = 16
BLOCKS = "part int, block int, inside long, n_docs int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n, level, is_leaf = len(order), leaves, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < n)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_tables(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next `limit` bits."""
    order = np.array(sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)), np.int64)
    fill = 1 << (limit - lengths[order])
    symbols, sizes = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(fill.sum())
    symbols[:n], sizes[:n] = np.repeat(order, fill), np.repeat(lengths[order], fill)
    return symbols, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Bits and checkpoints of a block."""
    size = lengths[ids]
    end = np.cumsum(size)
    at = end - size
    total = int(end[-1]) if len(end) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        word, code, room = at >> 6, codes[ids], 64 - (at & 63) - size
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], at[::STEP].astype("<u8").tobytes()


def unpack(bits: bytes, checkpoints: bytes, n: int, symbols: np.ndarray, sizes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of a block: all its checkpoints are decoded in step, one id of each at a time."""
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    words = np.frombuffer(bits + bytes(-len(bits) % 8 + 16), ">u8").astype(np.uint64)
    out, last = np.zeros((len(at), STEP), np.uint32), len(words) - 2
    for k in range(STEP):
        word, off = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
        ahead = (words[word] << off) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
        ahead >>= np.uint64(64 - limit)
        out[:, k] = symbols[ahead]
        at = at + sizes[ahead]
    return out.reshape(-1)[:n]


def count_ids(tokens: DataFrame, size: int, narrow: str) -> np.ndarray:
    """How often each id occurs in all documents; one row per id reaches the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        wordbpe.release()
        for batch in batches:
            for part in common.slices(batch):
                total += np.bincount(common.runs_of(part.column(0), narrow)[0], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["symbol", "n"])

    rows = tokens.select("ids").mapInArrow(count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["symbol"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, limit: int = LIMIT, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode the texts of docs (doc_id, text) into a new file at `path`."""
    spark = docs.sparkSession
    size, narrow, n = common.vocabulary_size(tokenizer), common.narrow(tokenizer), common.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text"), F.monotonically_increasing_id().alias("place"))

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for part in common.slices_of_bytes(batch, 1):
                ids, at = common.encode(part.column(1), tokenizer)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), common.binary_rows(ids, at)], ["doc_id", "place", "ids"])

    # The texts are tokenised once; their ids are read for the counts and again for the code.
    tokens = common.materialise(docs.mapInArrow(encode, "doc_id long, place long, ids binary"), "tokens")
    lengths = code_lengths(count_ids(tokens, size, narrow), limit)
    codes = canonical_codes(lengths)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, block, inside = TaskContext.get().partitionId(), 0, 0
        wide = np.dtype(narrow).itemsize

        def flush():
            nonlocal block, inside
            whole = np.frombuffer(b"".join(held), narrow)
            bits, marks = pack(whole, codes, lengths)
            row = [part, block, inside, len(held), len(whole), names, [len(x) // wide for x in held], marks, bits]
            block, inside = block + 1, inside + len(whole)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "block", "inside", "n_docs", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits"])

        names, held, size = [], [], 0
        for batch in batches:
            for piece in common.slices(batch):
                for doc, ids in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if size >= block_tokens * wide:
                        yield flush()
                        names, held, size = [], [], 0
                    names.append(doc)
                    held.append(ids)
                    size += len(ids)
        if held:
            yield flush()

    spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    order = [F.col("doc_id").asc_nulls_first(), F.substring("ids", 1, HEAD), F.xxhash64("ids"), F.col("place")]
    dealt = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """Documents of a file, decoded: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["symbol"].max()) + 1 if len(book) else 1, np.int64)
    lengths[book["symbol"].to_numpy(np.int64)] = book["length"].to_numpy(np.int64)
    symbols, sizes = decode_tables(lengths, limit)

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["bits"], row["checkpoints"], row["n_tokens"], symbols, sizes, limit).astype("<u4")
                n = np.array(row["doc_tokens"], np.int64)
                start = np.cumsum(n) - n
                texts = [ids[s : s + k].tobytes() for s, k in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start + row["before"]), pa.array(n), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # Starts in two levels: blocks know theirs in their part; of parts there are as many as the writer had partitions.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = blocks.join(F.broadcast(parts), "part").select((F.col("base") + F.col("inside")).alias("before"), "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def checksums(rows: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_huffman_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a token file and read back: doc_id, start, n_tokens, ids_crc32."""
    path = common.scratch_path(spark, "token-file")
    write(common.table(spark, sf_dir, "documents"), path, common.default_tokenizer())
    return checksums(read(spark, path))
