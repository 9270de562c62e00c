"""Lexical retrieval packing: windows filled with BM25 neighbours of a seed document.

Documents become token ids with an end id. Every full window inside a long document is a sequence of its own;
what remains of each document is packed. Remainders are dealt to shards of bounded size along a min-hash of
their ids, so that texts with common words meet; equal hashes are dealt on by doc_id and place in the input, so a hot group of copies
fills many shards. Each shard holds a BM25 inverted index over its remainders, with document frequencies and
mean length of the whole corpus. The longest unused remainder seeds a window and queries the index with its `query_terms` heaviest
terms (by their own BM25 weight in it; None: with all); unused neighbours fill the window in order of score, then, if no scored one is left, unused ones in order of length.
The one that overruns is cut and its rest stays unused. Only the last window of a shard can be short.

Nulls: a null text is empty, its end id alone; a null doc_id is packed like any other and returned as null.
Repeated rows are packed once each. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbpe

WINDOW = 4096
#: Ids after which a shard is closed: 512 windows.
SHARD_TOKENS = 1 << 21
#: Terms of a seed that query the index, unless the caller asks for more.
QUERY_TERMS = 32
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, place, route (min-hash of the ids), n_tokens, ids (little-endian, 16 bits each where the vocabulary allows)."""
    hashes = (_hashed(np.arange(common.vocabulary_size(tokenizer))) >> np.uint64(1)).view(np.int64)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for part in common.slices_of_bytes(batch, 1):
                ids, at = common.encode(part.column(1), tokenizer)
                # The end id is in every text, so it doesn't route, unless it is alone.
                h, n = hashes[ids], np.diff(at)
                h[at[1:][n > 1] - 1] = np.iinfo(np.int64).max
                route = np.minimum.reduceat(h, at[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(route), pa.array(n), common.binary_rows(ids, at)], ["doc_id", "place", "route", "n_tokens", "ids"])

    docs = docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text"), F.monotonically_increasing_id().alias("place"))
    return docs.mapInArrow(encode, "doc_id long, place long, route long, n_tokens long, ids binary")


def _hashed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs."""
    s = np.sort(ids, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
    return s[first], np.diff(np.concatenate([first, [len(s)]]))


def statistics(tokens: DataFrame, size: int, narrow: str) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id over all documents, their number and their ids."""

    def count(batches):
        import pyarrow as pa

        df, n, total = np.zeros(size, np.int64), 0, 0
        wordbpe.release()
        for batch in batches:
            for part in common.slices(batch):
                each = [np.frombuffer(x, narrow) for x in part.column(0).to_pylist()]
                df += np.bincount(np.concatenate([terms(x)[0] for x in each]), minlength=size)
                n, total = n + len(each), total + sum(map(len, each))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen], pa.int32()), pa.array([n, total, *df[seen]], pa.int64())], ["term", "n"])

    rows = tokens.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by, df = dict(zip(rows["term"], rows["n"], strict=True)), np.zeros(size, np.int64)
    seen = rows[rows["term"] >= 0]
    df[seen["term"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    return df, int(by.get(-1, 0)), int(by.get(-2, 0))


class Index:
    """BM25 postings of a shard's documents, by term."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int | None = QUERY_TERMS):
        found = [terms(t) for t in texts]
        n = np.array([len(t) for t, _ in found])
        term = np.concatenate([t for t, _ in found])
        tf = np.concatenate([f for _, f in found]).astype(np.float32)
        doc = np.repeat(np.arange(len(texts)), n)
        size = np.array([len(t) for t in texts], np.float32)[doc]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        # A document queries with its own heaviest terms.
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        self.own, self.own_weight = term, weight
        at = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[at], weight[at].astype(np.float64)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        self.n, self.query_terms = len(texts), query_terms

    def scores(self, i: int) -> np.ndarray:
        a, b = self.bounds[i], self.bounds[i + 1]
        own, weight = self.own[a:b], self.own_weight[a:b]
        if self.query_terms is not None and len(own) > self.query_terms:
            own = own[np.argpartition(-weight, self.query_terms)[: self.query_terms]]
        rows = [slice(self.start[t], self.start[t + 1]) for t in own]
        return np.bincount(np.concatenate([self.doc[r] for r in rows]), np.concatenate([self.weight[r] for r in rows]), minlength=self.n)


def pack_shard(texts: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, query_terms: int | None = QUERY_TERMS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (text, start, length); together they hold each id once."""
    sequences, start = [], [0] * len(texts)
    for i, t in enumerate(texts):
        while len(t) - start[i] >= window:
            sequences.append([(i, start[i], window)])
            start[i] += window
    rest = [i for i, t in enumerate(texts) if len(t) > start[i]]
    if not rest:
        return sequences
    index = Index([texts[i][start[i] :] for i in rest], idf, mean, query_terms)
    left = np.array([len(texts[i]) - start[i] for i in rest])
    order = np.argsort(-left, kind="stable")

    def take(k: int, room: int) -> tuple[int, int, int]:
        i, n = rest[k], min(int(left[k]), room)
        start[i] += n
        left[k] -= n
        return i, start[i] - n, n

    next_long = 0
    for seed in order:
        if not left[seed]:
            continue
        sequence = [take(seed, window)]
        room = window - sequence[0][2]
        if room:
            score = index.scores(seed)
            score[left == 0] = 0
            for k in np.argsort(-score, kind="stable"):
                if not room or score[k] <= 0:
                    break
                sequence.append(take(k, room))
                room -= sequence[-1][2]
        while room and next_long < len(order):
            k = order[next_long]
            if left[k]:
                sequence.append(take(k, room))
                room -= sequence[-1][2]
            else:
                next_long += 1
        sequences.append(sequence)
    return sequences


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = QUERY_TERMS) -> DataFrame:
    """One row per piece of a document; see PIECES. sequence_id is unique, not dense."""
    spark, size, narrow = docs.sparkSession, common.vocabulary_size(tokenizer), common.narrow(tokenizer)
    tokens = common.materialise(tokenised(docs, tokenizer), "tokens")
    df, n, total = statistics(tokens, size, narrow)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, total / max(1, n))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        sequence_id = TaskContext.get().partitionId() << 40
        wordbpe.release()
        ids, texts, held = [], [], 0

        def flush():
            nonlocal sequence_id, ids, texts, held
            rows = []
            for sequence in pack_shard(texts, idf, mean, window, query_terms):
                offset = 0
                for i, start, length in sequence:
                    piece = texts[i][start : start + length].astype("<u4").tobytes()
                    rows.append((ids[i], start, length, zlib.crc32(piece), len(texts[i]), sequence_id, offset))
                    offset += length
                sequence_id += 1
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for part in common.slices(batch, 256):
                for doc, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    texts.append(np.frombuffer(x, narrow))
                    held += len(texts[-1])
                    if held >= shard_tokens:
                        yield flush()
        if texts:
            yield flush()

    parts = min(common.partitions(spark), 1 + total // shard_tokens)  # no more than there are shards to fill
    order = ["route", F.xxhash64("doc_id"), "place"]
    dealt = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(run, PIECES)


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids, a row per piece."""
    return pack(common.table(spark, sf_dir, "documents"), common.default_tokenizer())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of every document it is given."""
    return pack(docs, common.default_tokenizer())
