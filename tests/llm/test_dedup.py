import hashlib
import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import common, exact, graph, simhash, substrings

from .conftest import full, prose


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(docs):
    groups = {}
    for r in docs.select("doc_id", "text").collect():
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    rows = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        rows += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(rows, key=str)


def test_exact_matches_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = duckdb.sql(exact.ORACLE)
    ours = exact.op7_exact_dedup(spark, sf).select(*answer.columns).collect()
    assert sorted(map(tuple, ours)) == sorted(answer.fetchall())


def test_exact_edges_and_weak_digests(tricky, nothing):
    for digest in (F.xxhash64, lambda c: F.xxhash64(c) % 2, lambda c: F.lit(0).cast("long")):
        rows = exact.resolve(tricky, digest=digest).collect()
        assert sorted(map(tuple, rows), key=str) == brute_exact(tricky)
    kept = exact.survivors(tricky)
    assert kept.schema == tricky.schema and kept.count() == len({norm(r.text) for r in tricky.collect()})
    assert exact.resolve(nothing).count() == 0 and exact.survivors(nothing).schema == nothing.schema


def test_exact_is_native(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(exact.common, "materialise", lambda df, label, f=exact.common.materialise: seen.append(df) or f(df, label))
    seen.append(exact.op7_exact_dedup(spark, sf))
    assert not any(re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString()) for df in seen)


def test_index_takes_batches(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(d, i, 10 * k) for k, (d, i) in enumerate(r)], "digest long, doc_id long, place long")
    index = exact.LsmIndex(spark, str(tmp_path / "i"))
    index.flush(rows((1, 5), (2, 6)))
    index.compact()
    index.flush(rows((1, 3), (1, None)))
    index.compact()
    assert sorted(map(tuple, index.read().collect())) == [(1, 3, 0, 3), (2, 6, 10, 1)]
    for n in (7, 1):
        index.flush(rows((2, n)))
        index.compact()
    assert sorted(map(tuple, index.read().collect())) == [(1, 3, 0, 3), (2, 1, 0, 3)]


def test_filters_let_members_through(spark, tmp_path):
    index = exact.LsmIndex(spark, str(tmp_path / "i"))
    for low in (0, 3000):
        index.flush(spark.range(low, low + 3000).select((F.col("id") * 7).alias("digest"), "id", F.col("id").alias("place")).withColumnRenamed("id", "doc_id"))
    probe = spark.range(42000).select(F.col("id").alias("digest"))
    for _ in (1, 2):  # by the runs' filters, then by the level's
        found = [r.digest for r in index.may_hold(probe).where("__in").collect()]
        assert {7 * i for i in range(6000)} <= set(found) and len(found) < 6000 + 0.2 * 36000
        index.compact()
    index.flush(spark.range(100).select((F.col("id") * 70).alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("place")))
    index.compact()
    again = {r.digest for r in index.may_repeat(probe).where("__in").collect()}
    assert {70 * i for i in range(100)} <= again and len(again) < 200 + 0.1 * 42000
    assert index.lookup(index.may_repeat(probe).where("__in")).where("group_size = 2").count() == 100


def test_filters_have_many_files(spark, tmp_path):
    index = exact.LsmIndex(spark, str(tmp_path / "i"))
    index.flush(spark.range(200_000).select(F.col("id").alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("place")))
    path, bits = index.members[0]
    assert bits == 1 << 22 and spark.read.parquet(path).count() == bits // exact.PAGE_BITS


def test_unique_texts_do_not_move(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(exact.common, "materialise", lambda df, label, f=exact.common.materialise: seen.setdefault(label, f(df, label)))
    docs = spark.createDataFrame([(i, f"text {i if i % 10 else 0}") for i in range(2000)], "doc_id long, text string")
    assert exact.resolve(docs).where("kept").count() == 1801
    assert 200 <= seen["probed"].count() < 400


def test_one_id_on_a_third_of_all_rows(spark):
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"text  {i % 4}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact.resolve(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(docs) and sum(r.kept for r in got) == 4


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    label = {f: f for f in fps}
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    keys = list(label)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [least.get(root(f)) for f in fps]


def check_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], fps, brute_components(fps, [r.doc_id for r in rows]), strict=True), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == want


def test_many_hashes_at_once_are_xxh64():
    r = random.Random(11)
    raw = bytes(r.randrange(256) for _ in range(5000))
    start = np.array([r.randrange(4900) for _ in range(3000)])
    size = np.array([r.choice((0, 1, 3, 4, 7, 8, 12, 15, 16, 23, 24, 28, 31, 32, 33, 64, 90, r.randrange(100))) for _ in range(3000)])
    got = simhash.xxh64(raw, start, np.minimum(size, 5000 - start))
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(start, size, strict=True)]


def test_fingerprints_of_odd_texts(monkeypatch):
    r = random.Random(12)
    texts = ["", " ", "A", "a b", "A b C", "a  b\tc\nd", "É é Ünï 日本 x", "\x0b\x0c\r", "w" * 40 + " x y z", "a\u00a0b c d"] + [" ".join(r.choice(["ab", "Cd", "éf", "x" * r.randrange(1, 40)]) for _ in range(r.randrange(300))) for _ in range(60)]
    want = [brute_fingerprint(t) for t in texts]
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == want
    assert simhash.fingerprints_of([b""]).tolist() == [0]


def test_simhash(spark, sf, tricky, nothing):
    check_simhash(spark.read.parquet(f"{sf}/documents.parquet"))
    check_simhash(tricky)
    base = prose(5, 400).split()
    near = [full(i, " ".join(w if random.Random(i * 1000 + k).random() > 0.004 else "changed" for k, w in enumerate(base))) for i in range(60)]
    check_simhash(spark.createDataFrame(near, tricky.schema))
    assert simhash.groups(nothing).count() == 0
    kept = simhash.stage(spark, tricky, "")
    assert kept.columns == tricky.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id is null").count() == 2


def test_simhash_matches_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = duckdb.sql(simhash.ORACLE)
    assert sorted(map(tuple, simhash.op8_simhash_pigeonring(spark, sf).select(*answer.columns).collect())) == sorted(answer.fetchall())


def test_hot_keys_are_dealt_on(spark, tricky, monkeypatch):
    base = prose(6, 500).split()
    near = [full(i, " ".join(w if random.Random(i * 1000 + k).random() > 0.006 else "changed" for k, w in enumerate(base))) for i in range(150)]
    monkeypatch.setattr(simhash, "HOT", 20)
    labels = []
    monkeypatch.setattr(simhash.common, "materialise", lambda df, label, f=simhash.common.materialise: labels.append(label) or f(df, label))
    check_simhash(spark.createDataFrame(near, tricky.schema))
    assert "hot-keys" in labels


def test_simhash_stage_keeps_any_column(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words stand here", "z")], "doc_id long, text string, __gone string")
    for sent in (simhash.SENT, 0):
        simhash.SENT, kept = sent, simhash.SENT
        try:
            assert sorted(map(tuple, simhash.stage(spark, docs, "").collect())) == [(1, "a b c d", "x"), (3, "other words stand here", "z")]
        finally:
            simhash.SENT = kept


def test_links_are_complete_at_every_group_size(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(simhash, "BLOCK", 60)
    for n in (2, 40, 50, 400):
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False))) for _ in range(n)], np.uint64))
        found = simhash.links(np.zeros(len(fps), np.int64), fps)
        assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in found)
        label = {int(f): int(f) for f in fps}
        def root(x):
            while label[x] != x:
                x = label[x]
            return x
        for a, b in found:
            label[root(int(a))] = root(int(b))
        for i, a in enumerate(fps.tolist()):
            for b in fps.tolist()[i + 1 :]:
                assert (a ^ b).bit_count() > 3 or root(a) == root(b)


def test_pigeonring_loses_no_pair():
    rng = random.Random(2)
    for _ in range(3000):
        x = 0
        for b in rng.sample(range(64), rng.randrange(4)):
            x |= 1 << b
        starts = np.arange(8)
        good = simhash.chain_holds(np.full(8, x, np.uint64), starts)
        assert good.any()
        s = int(np.flatnonzero(good)[0])
        parts = [(x >> (8 * ((s + j) % 8)) & 255).bit_count() for j in range(5)]
        assert parts[0] == parts[1] == 0 and sum(p > 0 for p in parts[2:]) <= 1


@pytest.mark.parametrize("together", [graph.TOGETHER, 0])
def test_components(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_are_all_of_them():
    rng = np.random.default_rng(4)
    first = np.array([0, 30, 30, 95, 100])
    h = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    h[40:50] = h[50:60]
    for least in (1, 5, 16):
        l, c, r = substrings.compact_windows(h, first, 2, least)
        v = (substrings._mix(h + np.uint64(5 * 0xD1B54A32D192ED03 % (1 << 64))) & ~substrings.PLACE) | np.arange(100, dtype=np.uint64)
        want = {}
        for a, b in zip(first, first[1:], strict=False):
            for i in range(a, b):
                for j in range(i + least - 1, b):
                    k = i + int(v[i : j + 1].argmin())
                    lo, hi = want.get(k, (i, j))
                    want[k] = (min(lo, i), max(hi, j))
        assert {int(k): (int(x), int(y)) for x, k, y in zip(l, c, r, strict=True)} == want


def test_passages(spark, tricky, nothing):
    shared, other = prose(10, 60), prose(11, 120)
    edited = " ".join("new" if i in (30, 80) else w for i, w in enumerate(other.split()))
    texts = [prose(20, 200) + " " + shared + " " + prose(21, 100), prose(22, 50) + " " + shared, other, prose(23, 300) + " " + edited + " " + prose(24, 30), prose(25, 400), prose(26, 30) + " " + " ".join(shared.split()[:40]) + " " + prose(27, 90)]
    docs = spark.createDataFrame([full(i, t) for i, t in enumerate(texts)], tricky.schema)
    found = {(r.doc_id, r.source_doc_id): r for r in substrings.passages(docs).collect()}
    assert set(found) == {(1, 0), (3, 2)}
    one, two = found[1, 0], found[3, 2]
    assert texts[1].split()[one.start_word : one.end_word] == shared.split() == texts[0].split()[one.source_start_word : one.source_end_word]
    assert two.similarity >= 0.8 and (two.start_word, two.end_word) == (300, 420)
    hits = {(r.doc_id, r.source_doc_id) for r in substrings.passages(tricky).collect()}
    assert (2, 1) in hits and any(d == 8 for d, _ in hits) and not any(d in (3, 4, 5, 6, 7) for d, _ in hits)
    assert substrings.passages(nothing).count() == 0


def test_a_passage_in_many_documents(spark, tricky):
    line, shared = prose(30, 12), prose(31, 70)
    docs = [full(i, f"{prose(100 + i, 60)} {line} {shared if i % 2 else prose(300 + i, 70)} {prose(500 + i, 40)}") for i in range(60)]
    found = substrings.passages(spark.createDataFrame(docs, tricky.schema)).collect()
    assert {r.doc_id for r in found} == {i for i in range(60) if i % 2} - {1}


def test_variants_of_one_passage_are_all_reached(spark, tricky):
    docs = []
    for n in range(40):  # the first and the third differ too much, the second is like both
        words = prose(1000 + n, 60).split()
        for k, at in enumerate(([20], [], [40])):
            docs.append(full(3 * n + k, f"{prose(2000 + 3 * n + k, 60)} {' '.join('other' if i in at else w for i, w in enumerate(words))} {prose(4000 + 3 * n + k, 60)}"))
    found = {(r.doc_id, r.source_doc_id) for r in substrings.passages(spark.createDataFrame(docs, tricky.schema)).collect()}
    assert sum((3 * n + 2, 3 * n + 1) in found for n in range(40)) >= 34
    assert not any((3 * n + 2, 3 * n) in found for n in range(40))


def test_a_passage_is_linked_to_all_its_variants(spark, tricky):
    r, docs, links = random.Random(12), [], set()
    for n in range(12):  # ten variants, each with a word changed, put in or left out elsewhere, stand before the passage that all of them are like
        words, whole = prose(50000 + n, (56, 60, 80, 110)[n % 4]).split(), 11 * n + 10
        for k, at in enumerate(r.sample(range(8, len(words) - 8), 10)):
            variant = words[:at] + ([f"other{n}"] if k % 4 < 3 else []) + words[at + (k % 4 != 2) :]
            docs.append(full(11 * n + k, f"{prose(60000 + 11 * n + k, 60)} {' '.join(variant)} {prose(80000 + 11 * n + k, 60)}"))
            links.add((whole, 11 * n + k))
        docs.append(full(whole, f"{prose(60000 + whole, 60)} {' '.join(words)} {prose(80000 + whole, 60)}"))
    found = {(x.doc_id, x.source_doc_id) for x in substrings.passages(spark.createDataFrame(docs, tricky.schema)).collect()}
    assert len(links & found) >= 0.97 * len(links), len(links - found)
    assert all(a // 11 == b // 11 for a, b in found)


def dealt(texts):
    """Windows of the first hash as they reach a task: columns of WINDOW but `whole`, sorted."""
    h, first = substrings.shingles(pa.array(texts))
    l, c, r = substrings.compact_windows(h, first, 0)
    doc = np.searchsorted(first, c, side="right") - 1
    zero = np.zeros(len(c), np.int64)
    columns = [h[c].view(np.int64), doc, (c - first[doc]).astype(np.int32), ((c - l) << 15 | (r - c)).astype(np.int32), zero.astype(np.int32), zero, *substrings._sides(h, c, 0)]
    order = np.lexsort((columns[2], doc, columns[0]))
    return [x[order] for x in columns]


def test_variants_in_chunks_and_copies_of_variants():
    words = prose(93, 70).split()
    edited = " ".join("other" if i == 30 else w for i, w in enumerate(words))
    columns = dealt([f"{prose(94000 + n, 60)} {' '.join(words) if n % 2 else edited} {prose(95000 + n, 60)}" for n in range(200)])
    once = sorted(p for x in substrings.Variants().link(columns, last=True) for p in zip(*x, strict=True))
    linker, apart = substrings.Variants(), []
    for i in range(0, len(columns[0]), 60):
        for x in linker.link([x[i : i + 60] for x in columns], last=i + 60 >= len(columns[0])):
            apart += zip(*x, strict=True)
    assert sorted(apart) == once
    assert {b for _, b, *_ in once} >= set(range(1, 200))
    assert len({(a, b) for a, b, *_ in once if (a + b) % 2}) < 100 * 100 / 10  # copies of one variant aren't each linked to those of the other


def test_links_of_many_variants_are_in_proportion_to_documents(spark, tricky, tmp_path):
    r, n, words = random.Random(14), 240, prose(97, 80).split()
    texts = [" ".join("other" + str(k) if i == at else w for i, w in enumerate(words)) for k in range(n) for at in [r.randrange(80)]]
    docs = spark.createDataFrame([full(k, f"{prose(96000 + k, 60)} {t} {prose(98000 + k, 60)}") for k, t in enumerate(texts)], tricky.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = substrings.op6_compact_window_passages(spark, str(tmp_path)).collect()
    every = {(x.doc_id, x.source_doc_id) for x in substrings.passages(docs).collect()}
    assert len(every) > n * n / 4 and len(rows) < 32 * n, (len(every), len(rows))
    assert {x.doc_id for x in rows} == set(range(1, n)) and {x.class_id for x in rows} == {0}
    for x in rows:
        assert x.source_doc_id < x.doc_id and x.similarity >= 0.8 and x.end_word - x.start_word >= 50


def test_a_forest_joins_what_all_links_join():
    rng, n = np.random.default_rng(15), 80
    before, after = rng.integers(0, substrings.LEAST, 3000), rng.integers(0, substrings.LEAST, 3000)
    j = rng.integers(1, n, 3000)
    links = [x[before + after + 1 >= substrings.LEAST] for x in (rng.integers(0, j), j, before, after)]
    forest, kept = substrings.Forest(n), []
    for low in range(0, len(links[0]), 200):
        part = [x[low : low + 200] for x in links]
        kept += (low + np.flatnonzero(forest.kept(*part))).tolist()
    assert len(kept) < len(links[0]) / 2

    def joined(rows, k):
        label = list(range(n))
        for a, b, x, y in zip(*(v[rows].tolist() for v in links), strict=True):
            if substrings.LEAST - 1 - y <= k <= x and label[a] != label[b]:
                one, two = label[a], label[b]
                label = [min(one, two) if v in (one, two) else v for v in label]
        return label

    for k in range(substrings.LEAST):
        want = joined(np.arange(len(links[0])), k)
        assert joined(np.array(kept), k) == want == forest.label[k].tolist()


def test_a_quoting_document_hides_no_copies(spark, tricky):
    docs = []
    for n in range(60):  # the first holds the passage in pieces of 48 words, the other two hold it whole
        words = prose(7000 + n, 120).split()
        quoted = " ".join(f"{prose(8000 + 10 * n + i, 25)} {' '.join(words[i * 48 : i * 48 + 48])}" for i in range(3))
        docs += [full(3 * n, quoted)] + [full(3 * n + k, f"{prose(9000 + 3 * n + k, 70)} {' '.join(words)} {prose(9500 + 3 * n + k, 70)}") for k in (1, 2)]
    found = substrings.passages(spark.createDataFrame(docs, tricky.schema)).collect()
    whole = {r.doc_id for r in found if r.source_doc_id == r.doc_id - 1 and r.doc_id % 3 == 2 and r.start_word <= 70 and r.end_word >= 190}
    assert len(whole) >= 57 and {r.doc_id for r in found if r.doc_id % 3 == 2} == {3 * n + 2 for n in range(60)}


def repeated_runs(texts, n=substrings.WORDS):
    """doc_id -> word positions inside a run of n words that an earlier document holds."""
    seen, repeated = {}, {}
    for doc, text in texts:
        words = text.lower().split()
        for i in range(len(words) - n + 1):
            run = hashlib.md5(" ".join(words[i : i + n]).encode()).digest()
            if seen.setdefault(run, doc) != doc:
                repeated.setdefault(doc, set()).update(range(i, i + n))
    return repeated


def test_every_repeated_run_of_the_tables_is_covered(spark):
    d = "/root/testdata/sf0.01"
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    covered = {}
    for r in substrings.op6_compact_window_passages(spark, d).collect():
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert not {doc: len(places - covered.get(doc, set())) for doc, places in repeated_runs(texts).items() if places - covered.get(doc, set())}


def test_recall_of_edited_passages(spark, tricky):
    r, docs, edits = random.Random(8), [], (0, 1, 1, 2)
    for n in range(200):  # a word changed for every 50 at most
        words = prose(20000 + n, 50 * max(1, edits[n % 4]) + 10).split()
        other = [*words]
        for k in range(edits[n % 4]):
            other[50 * k + r.randrange(5, 50)] = "other"
        docs += [full(2 * n + k, f"{prose(30000 + 2 * n + k, 80)} {' '.join(w)} {prose(40000 + 2 * n + k, 80)}") for k, w in enumerate((words, other))]
    found = {(x.doc_id, x.source_doc_id) for x in substrings.passages(spark.createDataFrame(docs, tricky.schema)).collect()}
    assert found <= {(2 * n + 1, 2 * n) for n in range(200)} and len(found) >= 190, len(found)


def test_documents_without_ids_are_compared(spark, tricky):
    shared = prose(60, 100)
    docs = [full(None, f"{prose(61, 60)} {shared}"), full(None, f"{prose(62, 60)} {shared}"), full(3, f"{prose(63, 60)} {shared}"), full(4, f"{prose(64, 80)} {shared}"), full(4, f"{prose(65, 60)} {shared}")]
    found = substrings.passages(spark.createDataFrame(docs, tricky.schema)).collect()
    assert sorted((r.doc_id or 0, r.source_doc_id or 0) for r in found) == [(0, 3), (0, 3), (4, 3), (4, 3)]


def test_windows_of_very_long_texts(monkeypatch):
    rng = np.random.default_rng(9)
    h, first = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.array([0, 1200, 3000])
    want = [x.tolist() for x in substrings.compact_windows(h, first, 1)]
    monkeypatch.setattr(substrings, "PLACE", np.uint64((1 << 11) - 1))
    assert [x.tolist() for x in substrings.compact_windows(h, first, 1)] == want


def test_a_hot_key_is_linked_in_chunks():
    rng = np.random.default_rng(10)
    n, steps = 500, len(substrings.STEPS)
    extent = np.full(n, 30 << 15 | 40, np.int32)
    columns = [np.zeros(n, np.int64), np.arange(n), np.full(n, 30, np.int32), extent, rng.integers(0, 3, n, dtype=np.int32), rng.integers(0, 3, n) << 21, rng.integers(0, 3, (n, steps)).astype(np.uint32)]
    once = sorted(zip(*substrings.Linker().link(columns, last=True), strict=True))
    linker, apart = substrings.Linker(), []
    for i in range(0, n, 60):
        apart += zip(*linker.link([x[i : i + 60] for x in columns], last=i + 60 >= n), strict=True)
    assert sorted(apart) == once and n < len(once) < 20 * n


def compared(x, y):
    return substrings.compare(*(substrings.shingles(pa.array([t]))[0].astype(np.uint32) for t in (x, y)))


def test_a_passage_beside_a_weaker_one_is_found():
    words = prose(90, 120).split()
    edited = " ".join("other" if i == 30 or i >= 60 and i % 9 == 5 else w for i, w in enumerate(words))
    for one, two in ((" ".join(words), edited), (" ".join(words[::-1]), " ".join(edited.split()[::-1]))):
        found = compared(one, two)
        assert any(e - s + substrings.SHINGLE >= 58 and same >= 0.8 for s, e, *_, same in found), found


def test_an_earlier_phrase_does_not_widen_a_passage():
    words = prose(91, 70).split()
    phrase, passage = " ".join(words[40:46]), " ".join("other" if i == 20 else w for i, w in enumerate(words))
    found = compared(f"{phrase} {prose(92, 20)} {' '.join(words)}", f"{prose(93, 26)} {passage}")
    assert any(e - s + substrings.SHINGLE >= 68 and same >= 0.8 for s, e, *_, same in found), found


def test_many_variants_are_joined_without_trying_all_pairs(monkeypatch):
    r, words = random.Random(16), prose(99, 90).split()

    def linked(n, many):
        tried = []
        monkeypatch.setattr(substrings, "MANY", many)
        monkeypatch.setattr(substrings, "variants", lambda *x: tried.append(len(x[4])) or variants(*x))
        links = [p for x in substrings.Variants(False).link([x.copy() for x in columns[n]], last=True) for p in zip(x[0].tolist(), x[1].tolist(), strict=True)]
        label = list(range(n))
        for a, b in sorted(links):
            one, two = label[a], label[b]
            label = [min(one, two) if v in (one, two) else v for v in label]
        return sum(tried), label

    variants, columns = substrings.variants, {}
    for n in (400, 800):
        edits = [{r.randrange(90): f"other{r.randrange(9)}"} for _ in range(n)]
        columns[n] = dealt([f"{prose(101000 + k, 20)} {' '.join(e.get(i, w) for i, w in enumerate(words))} {prose(103000 + k, 20)}" for k, e in enumerate(edits)])
    few, one = linked(400, 30)
    more, two = linked(800, 30)
    every, all_one = linked(400, 1 << 30)
    assert one == all_one and two == linked(800, 1 << 30)[1]
    assert more < 3 * few and few < every / 2, (few, more, every)


def test_what_was_shuffled_goes_when_a_table_is_written(spark):
    dirs = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*")}
    setting, before = spark.conf.get(common.CLEANUP), files()
    assert common.materialise(spark.range(1000).repartition(4, "id"), "cleanup", free=True).count() == 1000
    assert spark.conf.get(common.CLEANUP) == setting
    for _ in range(50):
        left = {p for p in files() - before if p.name.endswith(".data") and p.stat().st_size > 2000}
        if not left:
            break
        time.sleep(0.1)
    assert not left
