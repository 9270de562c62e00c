"""Severity of toxic language by cumulative-link (proportional-odds) regression on sparse text features.

Grades are ordered: 0 clean, then GRADES - 1 grades of toxic documents, cut at equal shares of the labelled toxic ones by how
many toxic words they have (the labels themselves only say toxic or not). Which words count for a text's grade is found on the other parts of the
sample (of FOLDS), where the text isn't, so that a grade doesn't come from what the model learned on that very text. P(grade > k) = sigmoid(w.x - theta_k) with
one w for all ordered thresholds theta. x holds log(1 + count) of each selected feature of the words of a text, whole
words and word beginnings of 4 to 7 letters. A document's result is its grade probabilities' sum,
the expected severity, and whether it is toxic at all, at P(grade > 0) >= 0.5.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE per label, by hash of doc_id, one per group of
texts that share a min-hash of 5-word shingles, so that copies don't count as evidence. A feature is selected if SUPPORT or more
of the sample's toxic texts have it, relatively more than of the clean ones, and the log-likelihood ratio of the two shares is
SIGNIFICANT. Both are absolute, so the words of a language with few toxic labels are selected as well; what each is worth is
left to the regularised regression. Scoring reads every document.

Nulls: a null text is empty and scores as clean, as does a text without features; a null doc_id is returned as null; labels
with a null doc_id or a null label aren't used. Without labels of both kinds nothing is toxic and severity is 0.
Repeated rows are scored each. `clean` keeps all columns of its input, by any name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, wordbpe

SAMPLE = 6000
GRADES = 4
SUPPORT = 5
FOLDS = 5
#: Of chi-square with one degree of freedom: one chance in a thousand.
SIGNIFICANT = 10.83
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"\w+")
CACHE = 300_000


def features_of(word: str) -> list[str]:
    """A lower-case word's features: itself and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """index: column by feature. theta: ascending."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    theta: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 50.0))

    def counts(self, text: str, cache: dict) -> dict[int, int]:
        """How often each column's feature occurs."""
        found: dict[int, int] = {}
        for word in WORD.findall(text.lower()):
            at = cache.get(word)
            if at is None:
                if len(cache) >= CACHE:
                    cache.clear()
                at = cache[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            for k in at:
                found[k] = found.get(k, 0) + 1
        return found

    def columns(self, word: bytes, cache: dict) -> tuple[int, ...]:
        """The columns of a run without white space, as often as its words have their features."""
        at = cache.get(word)
        if at is None:
            if len(cache) >= CACHE:
                cache.clear()
            at = cache[word] = tuple(self.index[f] for w in WORD.findall(word.decode().lower()) for f in features_of(w) if f in self.index)
        return at

    def above(self, texts, cache: dict) -> np.ndarray:
        """P(grade > k) of each text of an Arrow string column, by threshold. Each distinct run without white space is looked at once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        # A word of Latin letters that begins like no feature has none; the others are looked up.
        low = pc.utf8_lower(coded.dictionary)
        starts = pa.array(sorted({f[: PREFIXES[0]] for f in self.index if len(f.rstrip("$")) >= PREFIXES[0]}), pa.string())
        plain = pc.and_(pc.match_substring_regex(low, r"^[0-9_a-zß-öø-ÿ]{4,}[^\p{L}\p{N}_]*$"), pc.invert(pc.is_in(pc.utf8_slice_codeunits(low, 0, PREFIXES[0]), starts)))
        asked = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        each = [self.columns(w, cache) for w in coded.dictionary.take(pa.array(asked)).cast(pa.binary()).to_pylist()]
        size = np.zeros(len(low), np.int64)
        size[asked] = list(map(len, each))
        number, score = coded.indices.to_numpy(), np.zeros(len(texts))
        place = np.flatnonzero(size[number])
        if len(place):
            doc = np.searchsorted(split.offsets.to_numpy(), place, side="right") - 1
            flat, at = np.array([k for c in each for k in c], np.int64), np.concatenate([[0], np.cumsum(size)])
            column, _ = wordbpe.gather(flat, at, number[place])
            both, n = np.unique(np.repeat(doc, size[number[place]]) * len(self.weights) + column, return_counts=True)
            score = np.bincount(both // len(self.weights), np.log1p(n) * self.weights[both % len(self.weights)], len(texts))
        return 1 / (1 + np.exp(np.minimum(700.0, self.theta - score[:, None])))


@dataclass
class Sparse:
    """A matrix by the rows, columns and values of what isn't 0 in it."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        return cls(*np.nonzero(x), x[np.nonzero(x)], x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        """Of the transpose."""
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int = GRADES, l2: float = 0.3, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalised maximum likelihood; thresholds are a first one and the logs of the gaps, so they stay ordered."""
    n, d = x.shape
    w, t = np.zeros(d), np.concatenate([[1.0], np.zeros(grades - 2)])
    m, v = np.zeros(d + grades - 1), np.zeros(d + grades - 1)
    above = np.arange(grades - 1)
    for step in range(1, steps + 1):
        rate = 0.03 * (1 + math.cos(math.pi * step / steps)) / 2
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        p = 1 / (1 + np.exp(-np.clip(x.times(w)[:, None] - theta, -40, 40)))  # P(grade > k)
        full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        q = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        slope = p * (1 - p)
        # d log q / d (w.x - theta_k): plus for k = grade - 1, minus for k = grade.
        part = (slope * ((above == grade[:, None] - 1) * 1.0 - (above == grade[:, None]) * 1.0)) / q[:, None]
        g_theta = -part.sum(0)
        g_t = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * math.exp(t[k]) for k in range(1, grades - 1)]])
        g = np.concatenate([x.back(part.sum(1)) - l2 * w, g_t]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w + move[:d], t + move[d:]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """toxic, text of at most `most` labelled documents of each kind, in the order of a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where("doc_id is not null and toxic is not null")
    chosen = None
    for kind in (True, False):
        some = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * most rows of two columns: small enough to send to every task.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def log_likelihood(have_bad: Column, have_good: Column, bad: int, good: int) -> Column:
    """Of the shares of toxic and clean texts (bad and good in all) that have a feature, against one share for both."""
    both = have_bad + have_good
    cells = [(have_bad, both * bad), (have_good, both * good), (bad - have_bad, (bad + good - both) * bad), (good - have_good, (bad + good - both) * good)]
    return 2 * sum((F.when(n > 0, n * F.log(n * (bad + good) / expected)).otherwise(0.0) for n, expected in cells), F.lit(0.0))


def selected(have_bad: Column, have_good: Column, bad: int, good: int) -> Column:
    """Whether a feature marks toxic texts: often enough, and by no chance."""
    if not bad or not good:
        return F.lit(False)
    return (have_bad >= SUPPORT) & (have_bad / bad > have_good / good) & (log_likelihood(have_bad, have_good, bad, good) >= SIGNIFICANT)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from the labelled documents among docs."""

    def prepare(batches):
        import pyarrow as pa
        import xxhash

        wordbpe.release()
        for batch in batches:
            for part in common.slices(batch):
                texts = [t.decode() for t in common.texts_of(part.column(1))]
                sketch = []
                for t in texts:
                    w = t.lower().encode().split()
                    sketch.append(min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
                yield pa.RecordBatch.from_arrays([pa.array(sketch, pa.int64()), part.column(0), pa.array(texts)], ["sketch", "toxic", "text"])

    rows = sample(docs, labels, most).mapInArrow(prepare, "sketch long, toxic boolean, text string")
    rows = common.materialise(rows.groupBy("sketch").agg(F.min_by(F.struct("toxic", "text"), F.struct("text", "toxic")).alias("row")).select("row.*"), "labelled")

    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))

    def seen(batches):
        import pyarrow as pa

        for batch in batches:
            n: dict[tuple[str, int], list[int]] = {}
            for toxic, text, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}:
                    n.setdefault((f, fold), [0, 0])[toxic] += 1
            names = list(n)
            for i in range(0, len(n), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), pa.array([k for _, k in part], pa.int32()), pa.array([n[k][1] for k in part], pa.int64()), pa.array([n[k][0] for k in part], pa.int64())], ["feature", "fold", "bad", "good"])

    folds = range(FOLDS)
    totals = {(k, toxic): 0 for k in folds for toxic in (False, True)} | {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = (sum(totals[k, toxic] for k in folds) for toxic in (True, False))
    if not bad or not good:
        return Model()
    own = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in folds for c in ("bad", "good")]
    counted = rows.mapInArrow(seen, "feature string, fold int, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), *own)
    # Selected on the whole sample, for the model; and on all folds but one, for the grades in that one.
    parts = [selected(F.col("bad") - F.col(f"bad{k}"), F.col("good") - F.col(f"good{k}"), bad - totals[k, True], good - totals[k, False]).alias(f"without{k}") for k in folds]
    either = " or ".join(["whole", *(f"without{k}" for k in folds)])
    chosen = counted.select("feature", selected(F.col("bad"), F.col("good"), bad, good).alias("whole"), *parts).where(either).collect()
    model = Model({f: i for i, f in enumerate(sorted(r.feature for r in chosen if r.whole))})
    graders = [{r.feature for r in chosen if r[f"without{k}"]} or set(model.index) for k in folds]
    if not model.index:
        return Model()

    def count(batches):
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            found, hits = [], []
            for text, fold in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(model.counts(text, cache))
                hits.append(sum(not graders[fold].isdisjoint(features_of(w)) for w in WORD.findall(text.lower())))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            columns = [[list(f) for f in found], [list(f.values()) for f in found], hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], ["toxic", "at", "n", "hits"])

    found = rows.mapInArrow(count, "toxic boolean, at array<int>, n array<int>, hits long").collect()
    found.sort(key=lambda r: (r.toxic, r.hits, sorted(zip(r.at, r.n, strict=True))))
    rows_of = np.repeat(np.arange(len(found)), [len(r.at) for r in found])
    x = Sparse(rows_of, np.array([k for r in found for k in r.at], np.int64), np.log1p(np.array([k for r in found for k in r.n], np.float64)), (len(found), len(model.index)))
    toxic = np.array([r.toxic for r in found])
    hits = np.array([r.hits for r in found])
    cuts = np.quantile(hits[toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="right"), 0)
    model.weights, model.theta = fit_ordinal(x, grade)
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), p_toxic, toxic of every row of docs, which needs doc_id and text only; __row is carried if it is there."""
    carry = ["__row"] * ("__row" in docs.columns)

    def run(batches):
        import pyarrow as pa

        cache: dict = {}
        wordbpe.release()
        for batch in batches:
            for part in common.slices_of_bytes(batch, 1):
                p = model.above(part.column(1), cache)
                each = np.diff(np.hstack([np.full((len(p), 1), -1.0), -p, np.zeros((len(p), 1))]), axis=1)
                columns = [part.column(0), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*columns, *([part.column(2)] if carry else [])], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic", *carry])

    kind = T.StructType.fromDDL("doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")
    if carry:
        kind = kind.add("__row", docs.schema["__row"].dataType)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), *carry).mapInArrow(run, kind)


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, likeliest grade and verdict."""
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs.select("doc_id", "text"), fit(docs, common.table(spark, sf_dir, "labels")))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    return scores(rows, model).where("not toxic").select("__row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, fit(docs, common.table(spark, sf_dir, "labels")))
