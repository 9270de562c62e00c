import time
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import common, packing, tokenfile, wordbpe

from .conftest import prose

PATH = common.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, common.END_ID]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_words_encode_as_the_library_does(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = wordbpe.of(PATH).encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_encodes_whole_documents(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    odd = ["naïve’s l'été don't I'LL 12ab34!'s <|endoftext|>x", "ß İ ΣΑΣ ﬁ ½ ² ª \x1c \x85", "é 日本 ３ 😀", "A" * 3000, "x." * 500]
    odd += ["Kelvin \u212a. \u212a", "ÀÉÎ.,. ÷ × a÷b", ".,", "a.b,c", "<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|>", "a" * 41, "É" * 21 + ".", "\u00a0a\u2028b", "x'S 'll' ''d", "a\x00b \ufeffc", None]
    ids, at = common.encode(pa.array(texts + odd), PATH)
    for t, a, b in zip(texts + odd, at, at[1:], strict=False):
        assert ids[a:b].tolist() == ids_of(t), t


def test_time_is_linear_in_a_word():
    for word in ("a", "é1", "日本", "%$", "x."):
        began = time.process_time()
        ids, _ = common.encode(pa.array([word * (1_000_000 // len(word))]), PATH)
        assert len(ids) > 1 and time.process_time() - began < 10, word


def test_other_vocabularies_are_left_to_the_library(sf):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, texts = Tokenizer.from_file(path), ["Two  spaces, é", "", "a b\n c"]
    ids, at = wordbpe.of(path).encode(pa.array(texts), 7)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*other.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_texts_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 9, 1, 1, 1)] + [None])], ["t"])
    assert [x.num_rows for x in common.slices_of_bytes(batch, 0, 4)] == [1, 1, 4]
    column = common.binary_rows(np.arange(6, dtype="<u2"), np.array([0, 2, 2, 6]))
    flat, at = common.runs_of(column.slice(1), "<u2")
    assert flat.tolist() == [2, 3, 4, 5] and at.tolist() == [0, 0, 4]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=200), st.integers(8, 18))
def test_code_is_a_full_prefix_code(counts, limit):
    lengths = tokenfile.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0]
    assert (lengths > 0).sum() == np.count_nonzero(counts) and used.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1
        assert len(set(zip(tokenfile.canonical_codes(lengths)[lengths > 0].tolist(), used.tolist(), strict=True))) == len(used)


@given(st.lists(st.integers(0, 40), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.int64)
    lengths = tokenfile.code_lengths(np.bincount(ids, minlength=41) ** 3, 12)
    bits, marks = tokenfile.pack(ids, tokenfile.canonical_codes(lengths), lengths)
    assert tokenfile.unpack(bits, marks, len(ids), *tokenfile.decode_tables(lengths, 12), 12).tolist() == ids.tolist()


def test_file_round_trip(spark, tricky, nothing, tmp_path):
    tokenfile.write(tricky, str(tmp_path / "f"), PATH, block_tokens=500)
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read(spark, str(tmp_path / "f")).collect()]
    docs = sorted(((r.doc_id, ids_of(r.text)) for r in tricky.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, start = [], 0
    for doc, ids in docs:
        want.append((doc, start, len(ids), ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    tokenfile.write(nothing, str(tmp_path / "e"), PATH)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


def test_one_id_is_cut_over_many_parts(spark, tmp_path):
    hot = spark.createDataFrame([(5 if i % 3 else i, f"text {i % 7}") for i in range(3000)], "doc_id long, text string")
    tokenfile.write(hot, str(tmp_path / "f"), PATH)
    parts = spark.read.parquet(str(tmp_path / "f/blocks")).groupBy("part").agg(F.sum("n_docs")).collect()
    assert len(parts) > 3 and max(n for _, n in parts) < 2000
    got = tokenfile.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in hot.collect()) and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def check_packing(docs, rows, window):
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids.setdefault(r.doc_id, []).append(ids_of(r.text))
    total = sum(r.length for r in rows)
    assert total == sum(len(x) for v in ids.values() for x in v)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for doc, texts in ids.items():
        if len(texts) == 1:
            at = 0
            for start, length in sorted((r.start, r.length) for r in rows if r.doc_id == doc):
                assert start == at
                at += length
            assert at == len(texts[0])
    return len(by_sequence) * window / total


def test_packing(spark, sf, tricky, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_packing(docs, packing.pack(docs, PATH).collect(), 4096) < 1.05
    check_packing(tricky, packing.pack(tricky, PATH, window=256, shard_tokens=2000).collect(), 256)
    assert packing.pack(nothing, PATH).count() == 0


def test_one_row_repeated_is_packed_in_many_tasks(spark):
    hot = spark.createDataFrame([(7 if i % 3 else None, prose(5, 200)) for i in range(3000)], "doc_id long, text string")
    rows = packing.pack(hot, PATH, window=1024, shard_tokens=20_000).collect()
    check_packing(hot, rows, 1024)
    tasks = {}
    for r in rows:
        tasks[r.sequence_id >> 40] = tasks.get(r.sequence_id >> 40, 0) + r.length
    assert len(tasks) == 4 and max(tasks.values()) < 0.5 * sum(tasks.values())


def test_a_query_may_have_all_terms():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300, 200).astype(np.uint16) for _ in range(20)]
    idf = np.ones(300, np.float32)
    all_terms, few = (packing.Index(texts, idf, 200.0, n).scores(0) for n in (None, 5))
    assert (all_terms >= few - 1e-9).all() and all_terms.sum() > few.sum()


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [np.arange(100 * k, 100 * k + 60) for k in range(4)]
    texts = [rng.choice(topics[i % 4], 60).astype(np.uint16) for i in range(32)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=400)
    idf = np.log(1 + (32 - df + 0.5) / (df + 0.5)).astype(np.float32)
    for sequence in packing.pack_shard(texts, idf, 60.0, window=240):
        assert len({i % 4 for i, _, _ in sequence}) == 1


def test_scores_are_bm25():
    texts = [np.array(x, np.uint16) for x in ([1, 2, 2], [2, 3], [4, 4, 4, 1])]
    idf = np.array([0, 0.5, 0.7, 1.1, 1.3], np.float32)
    got, mean = packing.Index(texts, idf, 3.0).scores(0), 3.0
    for d, t in enumerate(texts):
        want = sum(idf[w] * (t == w).sum() * 2.2 / ((t == w).sum() + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in (1, 2) if (t == w).any())
        assert abs(got[d] - want) < 1e-5
