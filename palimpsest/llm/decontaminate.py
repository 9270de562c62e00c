"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased runs without ASCII white space or punctuation. A test item's seeds are all its n-grams of SEED words, however
many documents hold them: the ones that an edited copy keeps may be common, not least because many documents hold that copy.
Around each seed that a document shares with an item the document's words are aligned with the item's (match 2, other word or gap
-1, local), unless too few of the item's words stand there to reach THRESHOLD in any order. The score is the alignment's share of a full match; at THRESHOLD or more the document holds the item. An item is
matched whole or in edited form, with words replaced, inserted, left out or moved a little, as long as SEED of its words still stand together
somewhere: every copy with words replaced that scores over THRESHOLD has such a place, since without one at least every third word is another. A copy with a foreign word after every
other one has none and isn't found. Aligning takes time as the square of an item's words, and memory in proportion.

The benchmark is the query set: it is sent to all tasks in blocks of at most BLOCK_WORDS words, each a pass over the documents,
so no more than a block is ever held.

Nulls and edges: null texts are empty; an item of fewer than SEED words has no seeds and matches nothing; null ids are
returned as null. Repeated documents or items give a row each. Empty tables give no rows, and leave all documents clean.
`clean` keeps all columns of its input, by any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbpe

SEED = 3
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
CELLS = 1 << 17
MATCH, MISS, GAP = 2, -1, -1
_BREAKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_BREAKS).split()


class Items:
    """A block of test items and an index of their n-grams."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32) for _, words in rows]
        grams, item, at = [], [], []
        for i, t in enumerate(self.texts):
            g = _grams(t)
            grams.append(g)
            item.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.kinds, self.kind = np.unique(self.gram, return_inverse=True)
        self.row = np.argsort(self.kind, kind="stable")
        self.start = np.searchsorted(self.kind[self.row], np.arange(len(self.kinds) + 1))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all texts in turn (0: in no item), the first of each, and the positions and kinds of n-grams that items have."""
        get = self.vocabulary.get
        each = [[get(w, 0) for w in words_of(t)] for t in texts]
        first = np.cumsum([0] + [len(e) + 1 for e in each])  # a 0 after each text keeps n-grams inside it
        ids = np.zeros(int(first[-1]), np.int32)
        for f, e in zip(first.tolist(), each, strict=False):
            ids[f : f + len(e)] = e
        if len(ids) < SEED or not len(self.kinds):
            return ids, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        run = known[: len(ids) - SEED + 1].copy()
        for k in range(1, SEED):
            run &= known[k : len(ids) - SEED + 1 + k]
        at = np.flatnonzero(run)
        gram = _hash([ids[at + k] for k in range(SEED)])
        kind = np.minimum(np.searchsorted(self.kinds, gram), len(self.kinds) - 1)
        hit = self.kinds[kind] == gram
        return ids, first, at[hit], kind[hit]

    def align(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """text, item, score, first word, end word of the best alignment of each text with each item that reaches THRESHOLD."""
        ids, first, at, kind = self.read(texts)
        n = self.start[kind + 1] - self.start[kind]
        if not n.sum():
            return []
        at = np.repeat(at, n)
        row = self.row[np.repeat(self.start[kind], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.searchsorted(first, at, side="right") - 1
        item, diagonal = self.item[row], at - self.at[row]
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        windows, size = [], np.array([len(t) for t in self.texts])
        low = 0
        for k in range(1, len(doc) + 1):  # seeds near each other's diagonal share a window
            if k == len(doc) or doc[k] != doc[low] or item[k] != item[low] or diagonal[k] - diagonal[low] > size[item[low]] // 2:
                m = int(size[item[low]])
                a, b = int(diagonal[low]) - m // 2, int(diagonal[k - 1]) + m + m // 2
                windows.append((int(doc[low]), int(item[low]), max(int(first[doc[low]]), a), min(int(first[doc[low] + 1]) - 1, b)))
                low = k
        # A score of THRESHOLD needs that share of the item's words to be matched, so to be there.
        windows = [w for w in windows if np.isin(self.texts[w[1]], ids[w[2] : w[3]]).sum() >= THRESHOLD * size[w[1]]]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        windows.sort(key=lambda w: (size[w[1]], w[3] - w[2]))
        for part in _together(windows):
            found = smith_waterman([self.texts[w[1]] for w in part], [ids[w[2] : w[3]] for w in part])
            good = [(w, s, e) for w, (s, e) in zip(part, found, strict=True) if s >= THRESHOLD * MATCH * size[w[1]]]
            if not good:
                continue
            back = smith_waterman([self.texts[w[1]][::-1] for w, _, _ in good], [ids[w[2] : w[2] + e][::-1] for w, _, e in good])
            for (w, s, e), (_, b) in zip(good, back, strict=True):
                span = (s / (MATCH * int(size[w[1]])), w[2] + e - b - int(first[w[0]]), w[2] + e - int(first[w[0]]))
                if (key := w[:2]) not in best or (-span[0], span[1]) < (-best[key][0], best[key][1]):
                    best[key] = span
        return [(d, i, *span) for (d, i), span in sorted(best.items())]


def _together(windows: list[tuple[int, int, int, int]]) -> Iterator[list]:
    """Windows in runs that are aligned at once, of at most CELLS words when as wide as their widest, or one."""
    part, wide = [], 0
    for w in windows:
        wide = max(wide, w[3] - w[2])
        if part and (len(part) + 1) * wide > CELLS:
            yield part
            part, wide = [], w[3] - w[2]
        part.append(w)
    if part:
        yield part


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _grams(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - SEED + 1
    return _hash([ids[k : k + n] for k in range(SEED)]) if n > 0 else np.zeros(0, np.uint64)


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int]]:
    """Best local score of each item with its window, and the window's words up to its first end. All pairs go row by row together."""
    n, m, w = len(items), max(map(len, items)), max(map(len, windows))
    item, window = np.full((n, m), -1, np.int32), np.full((n, w), -2, np.int32)
    for i, (a, b) in enumerate(zip(items, windows, strict=True)):
        item[i, : len(a)], window[i, : len(b)] = a, b
    column = np.arange(w, dtype=np.int32) * -GAP
    h, best, end = np.zeros((n, w + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(m):
        step = np.where(window == item[:, i : i + 1], MATCH, MISS)
        t = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        h[:, 1:] = np.maximum.accumulate(t + column, axis=1) - column  # gaps along the window
        top = h.max(1)
        at = np.flatnonzero(top > best)
        best[at], end[at] = top[at], h[at].argmax(1)
    return list(zip(best.tolist(), end.tolist(), strict=True))


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of at most `most` words, or one item."""
    held, size = [], 0
    for i, text in benchmark.select(F.col("item_id").cast("long"), common.text_of()).orderBy("item_id").toLocalIterator():
        words = words_of(text.encode())
        if held and size + len(words) > most:
            yield Items(held)
            held, size = [], 0
        held.append((i, words))
        size += len(words)
    if held:
        yield Items(held)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of every document that holds a test item."""
    spark, found = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text"))
    kind = "doc_id long, item_id long, score double, start_word long, end_word long"
    for items in blocks(benchmark):

        def run(batches, items=items):
            import pyarrow as pa

            wordbpe.release()
            for batch in batches:
                for part in common.slices(batch):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[d], items.ids[i], *span) for d, i, *span in items.align(common.texts_of(part.column(1)))]
                    columns = zip(*rows, strict=True) if rows else [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        rows = docs.mapInArrow(run, kind)
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns."""
    for items in blocks(benchmark):
        rows = docs.select(common.text_of().alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

        def run(batches, items=items):
            import pyarrow as pa

            wordbpe.release()
            for batch in batches:
                for part in common.slices(batch):
                    bad = {d for d, *_ in items.align(common.texts_of(part.column(0)))}
                    kept = part.filter(pa.array([i not in bad for i in range(part.num_rows)]))
                    yield pa.RecordBatch.from_arrays([kept.column(1)], ["row"])

        docs = rows.mapInArrow(run, rows.select("row").schema).select("row.*")
    return docs


def op1_seed_align_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item it holds."""
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, common.table(spark, sf_dir, "benchmark"))
