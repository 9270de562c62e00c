"""Near duplicates by SimHash fingerprints, with candidates pruned by the pigeonring principle.

A fingerprint of 64 bits is a ring of 8 segments. If two differ in at most 3 bits, some segment starts a chain of
which every prefix of length l differs in at most 3*l/8 bits: none in its first two segments, at most one in the next
three, two up to the seventh, three in all. So two of those three segments agree as well, and one of 24 keys of 32
exact bits (8 starts, 3 choices) meets every such pair. Distinct fingerprints are dealt by key; where there are more than HOT of them, a
key that more than HOT have is dealt on by its four other segments, one of which agrees as well, so it spreads over 1,024 keys of 40 bits. In each
key's group the chain's budgets prune pairs, the full distance decides. Small groups are compared pair by pair, groups of
up to BLOCK by a search that reaches each member once, larger ones are first split again by quarters of the bits in
which members may still differ, one of which must agree; none emits more than a spanning forest, and no pair is lost.
Components of the linked fingerprints are the classes.

Nulls: a null text is empty, its fingerprint zero; rows with a null doc_id belong to their fingerprint's class but don't
name it, and a class without any id has a null component_id. Repeated rows share a fingerprint. In `stage`, rows that share a doc_id
stay or go together and rows without one stay; all columns are kept, by any name. `groups` reads no others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, wordbpe

DISTANCE = 3
SEGMENTS = 8
SHINGLE = 3
SEED = 42
SMALL = 48
BLOCK = 4096
TEXT_BYTES = 2 << 20
#: Distinct fingerprints of a key in one task.
HOT = 1 << 20
#: Rows of a side that is sent to all tasks: 8 bytes each.
SENT = 1 << 20


# The constants of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(raw: bytes, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many pieces of a buffer; those of less than 32 bytes all together, the others by the library."""
    import xxhash

    words = np.frombuffer(raw + bytes(-len(raw) % 8 + 16), "<u8")

    def load(at: np.ndarray) -> np.ndarray:
        word, off = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (words[word] >> off) | ((words[word + 1] << np.uint64(1)) << (np.uint64(63) - off))

    acc = size.astype(np.uint64) + np.uint64(seed) + P5
    for k in range(3):
        on = np.flatnonzero((size >= 8 * (k + 1)) & (size < 32))
        piece = _turned(load(start[on] + 8 * k) * P2, 31) * P1
        acc[on] = _turned(acc[on] ^ piece, 27) * P1 + P4
    at = start + (size >> 3 << 3)
    on = np.flatnonzero(size & 4)
    acc[on] = _turned(acc[on] ^ ((load(at[on]) & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[on] += 4
    for k in range(3):
        on = np.flatnonzero((size & 3) > k)
        acc[on] = _turned(acc[on] ^ ((load(at[on] + k) & np.uint64(255)) * P5), 11) * P1
    acc = (acc ^ (acc >> np.uint64(33))) * P2
    acc = (acc ^ (acc >> np.uint64(29))) * P3
    acc ^= acc >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc[long] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
    return acc


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned fingerprints of UTF-8 texts."""
    raw = b"\n".join([b" ".join(t.lower().split()) for t in texts]) + b"\n"
    flat = np.frombuffer(raw, np.uint8)
    end = np.flatnonzero((flat == 32) | (flat == 10))  # of each word; of an empty text too
    start = np.concatenate([[0], end[:-1] + 1])
    text = np.concatenate([[0], np.cumsum(flat[end] == 10)[:-1]])
    words = np.bincount(text[end > start], minlength=len(texts))
    first = np.searchsorted(text, np.arange(len(texts)))
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], shingles)
    last = at + np.repeat(np.clip(words, 1, SHINGLE) - 1, shingles)
    h = xxh64(raw, start[at], end[last] - start[at]).astype(">u8").view(np.uint8).reshape(-1, 8)
    counts, of = np.zeros((len(texts), 64), np.int64), np.repeat(np.arange(len(texts)), shingles)
    for i in range(0, len(h), CHUNK):
        which = of[i : i + CHUNK]
        new = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        counts[which[new]] += np.add.reduceat(np.unpackbits(h[i : i + CHUNK], axis=1), new, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > shingles[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long)."""

    def run(batches):
        import pyarrow as pa

        wordbpe.release()
        for batch in batches:
            for part in common.slices_of_bytes(batch, 1, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(common.texts_of(part.column(1))).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def chain_holds(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the differing bits x keep every budget of the chain that begins at segment `start`."""
    total, good = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        at = (start + length - 1) % SEGMENTS
        total += np.bitwise_count((x >> (np.uint64(8) * at.astype(np.uint64))) & np.uint64(255))
        good &= total <= length * DISTANCE // SEGMENTS
    return good


def _reach(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps: each member is reached once."""
    left, found = np.arange(len(fps)), []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:256], frontier[256:]
            near = np.bitwise_count(fps[now][:, None] ^ fps[left][None, :]) <= DISTANCE
            hit = near.any(0)
            if hit.any():
                new = left[hit]
                found += zip(fps[now[near[:, hit].argmax(0)]].tolist(), fps[new].tolist(), strict=True)
                frontier, left = np.concatenate([frontier, new]), left[~hit]
    return found


def links(keys: np.ndarray, fps: np.ndarray, start: np.ndarray | None = None, bits: int = (1 << 64) - 1) -> list[tuple[int, int]]:
    """Edges that connect all linked fps within each run of equal keys; sorted by key, distinct within one.

    start: the chain's first segment, by row. bits: those in which members of a group may differ.
    """
    if len(keys) < 2:
        return []
    cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    size = np.diff(cut)
    small, found, step = np.repeat(size <= SMALL, size), [], 1
    while step < SMALL:
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(at):
            break
        x = fps[at] ^ fps[at + step]
        good = chain_holds(x, start[at]) if start is not None else np.ones(len(x), bool)
        good &= np.bitwise_count(x) <= DISTANCE
        found += zip(fps[at[good]].tolist(), fps[at[good] + step].tolist(), strict=True)
        step += 1
    for g in np.flatnonzero(size > SMALL):
        group = fps[cut[g] : cut[g + 1]]
        if len(group) <= BLOCK or bits.bit_count() <= 12:
            found += _reach(group)
            continue
        free = [i for i in range(64) if bits >> i & 1]
        for q in range(4):
            mask = sum(1 << i for i in free[q::4])
            part = group & np.uint64(mask)
            order = np.lexsort((group, part))
            found += links(part[order], group[order], None, bits & ~mask)
    return found


def _segment(i: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))


def _choices() -> list[tuple[int, list[int], list[int]]]:
    """First segment, exact and other segments of each of the 24 kinds of key."""
    chosen = [(i, [i, i + 1, *(i + j for j in (2, 3, 4) if j != skip)]) for i in range(SEGMENTS) for skip in (2, 3, 4)]
    return [(i, own, [i + j for j in range(SEGMENTS) if i + j not in own]) for i, own in chosen]


def candidate_keys() -> Column:
    """The 24 keys of column fp: which in bits 32 to 36, 32 bits of fingerprint below."""
    keys = []
    for which, (_, own, _) in enumerate(_choices()):
        key = F.lit(which << 32)
        for n, j in enumerate(own):
            key = key.bitwiseOR(F.shiftleft(_segment(j), 8 * n))
        keys.append(key)
    return F.array(*keys)


def narrower_keys() -> Column:
    """Four keys for a row (key, fp): with one more segment each, which in bits 45 and up, its value in bits 37 to 44."""
    which = F.shiftrightunsigned("key", 32)
    found = []
    for n in range(4):
        value = F.coalesce(*(F.when(which == k, _segment(others[n])) for k, (_, _, others) in enumerate(_choices())))
        found.append(F.col("key").bitwiseOR(F.shiftleft(value, 37)).bitwiseOR(F.lit((n + 1) << 45)))
    return F.array(*found)


def edges(distinct: DataFrame) -> DataFrame:
    """a, b: edges that connect all of the distinct fingerprints fp that link."""

    def run(batches):
        import pyarrow as pa

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            both = np.array(links(k, f, (k >> 32 & 31) // 3), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1]))  # the last key's group may go on
            if last:
                yield out(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield out(keys, fps)

    rows = distinct.select(F.explode(candidate_keys()).alias("key"), "fp")
    if distinct.count() > HOT:  # else no key can be hot
        hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")
        hot = common.materialise(hot, "hot-keys")  # 24 for every HOT fingerprints at most
        if not hot.isEmpty():
            apart = rows.join(F.broadcast(hot), "key", "left_semi").select(F.explode(narrower_keys()).alias("key"), "fp")
            rows = rows.join(F.broadcast(hot), "key", "left_anti").unionByName(apart)
    return rows.repartition(common.partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """fp, component_id of every fingerprint in prints (doc_id, fp) that has links to others or copies."""
    ids = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    labels = graph.components(edges(ids.select("fp")))
    labelled = ids.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "label").select("fp", "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = common.materialise(fingerprints(docs), "prints")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id it is linked to, directly or not."""
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that name their class."""
    gone = groups(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("not stays and doc_id is not null")
    name = common.fresh(docs, "__gone")
    gone = common.materialise(gone.select(F.col("doc_id").alias(name)), "gone")
    few = gone.count() <= SENT
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


# --- The same in DuckDB's dialect ----------------------------------------------------------------------------------------

_WHOLE = 1 << 64


def _wide(x) -> str:
    return f"({x})::UHUGEINT"


def _let(name: str, value: str, body: str) -> str:
    """body, with a name for a value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _times(x: str, p) -> str:
    return f"(({x}) * {_wide(int(p))} % {_wide(_WHOLE)})"


def _turn_sql(name: str, value: str, n: int) -> str:
    return _let(name, value, f"(({name} * {_wide(1 << n)}) % {_wide(_WHOLE)} + {name} // {_wide(1 << (64 - n))})")


def _round_sql(lane: str, value: str, name: str) -> str:
    return _times(_turn_sql(f"r{name}", f"(({lane}) + {_times(value, P2)}) % {_wide(_WHOLE)}", 31), P1)


def _number_sql(n: int, at: str) -> str:
    """n bytes of the list b of hex pairs, from `at` on, as a number; the first is the lowest."""
    return "('0x' || " + " || ".join(f"b[{at} + {i}]" for i in range(n, 0, -1)) + ")::UBIGINT::UHUGEINT"


def _xxh64_sql() -> str:
    """XXH64 of the n bytes whose hex pairs are the list b."""
    lanes, seed = "pqrs", SEED
    start = {"p": (seed + int(P1) + int(P2)) % _WHOLE, "q": (seed + int(P2)) % _WHOLE, "r": seed, "s": (seed - int(P1)) % _WHOLE}
    stripe = ", ".join(f"'{x}': {_round_sql(f'v.{x}', _number_sql(8, f'(t * 32 + {8 * i})'), x)}" for i, x in enumerate(lanes))
    striped = f"list_reduce(range(n // 32), lambda v, t: {{{stripe}}}, {{{', '.join(f"'{x}': {_wide(start[x])}" for x in lanes)}}})"
    long = f"({' + '.join(_turn_sql(f'm{x}', f'v.{x}', k) for x, k in zip(lanes, (1, 7, 12, 18), strict=True))}) % {_wide(_WHOLE)}"
    for x in lanes:
        long = _let(f"z{x}", long, f"(({_times(f'xor(z{x}, {_round_sql(_wide(0), f"v.{x}", f"y{x}")})', P1)} + {_wide(int(P4))}) % {_wide(_WHOLE)})")
    first = f"(CASE WHEN n >= 32 THEN {_let('v', striped, long)} ELSE {_wide(seed + int(P5))} END + n::UHUGEINT) % {_wide(_WHOLE)}"
    eight = _round_sql(_wide(0), _number_sql(8, "(n - n % 32 + t * 8)"), "w")
    eights = f"list_reduce(range(n % 32 // 8), lambda a, t: ({_times(_turn_sql('e', f'xor(a, {eight})', 27), P1)} + {_wide(int(P4))}) % {_wide(_WHOLE)}, {first})"
    four = _times(_number_sql(4, "(n - n % 8)"), P1)
    fours = _let("f", eights, f"CASE WHEN n % 8 >= 4 THEN ({_times(_turn_sql('g', f'xor(f, {four})', 23), P2)} + {_wide(int(P3))}) % {_wide(_WHOLE)} ELSE f END")
    one = _times(_number_sql(1, "(n - n % 4 + t)"), P5)
    made = f"list_reduce(range(n % 4), lambda a, t: {_times(_turn_sql('o', f'xor(a, {one})', 11), P1)}, {fours})"
    for name, n, p in (("i", 33, P2), ("j", 29, P3)):
        made = _let(name, made, _times(f"xor({name}, {name} // {_wide(1 << n)})", p))
    return f"({_let('x', made, f'xor(x, x // {_wide(1 << 32)})')})::UBIGINT"


_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END" for k in range(64))
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS line, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT line, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle FROM d),
  hashed AS (SELECT shingle, {_xxh64_sql()} AS h FROM (SELECT shingle, strlen(shingle) AS n, string_split(rtrim(regexp_replace(hex(encode(shingle)), '(..)', '\1,', 'g'), ','), ',') AS b FROM (SELECT DISTINCT shingle FROM s))),
  prints AS (SELECT line, {_BITS} AS fp FROM s JOIN hashed USING (shingle) GROUP BY line),
  all_of_them AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN prints USING (line)),
  kinds AS (SELECT fp, min(doc_id) AS least FROM all_of_them GROUP BY fp),
  links AS (SELECT a.fp AS a, b.fp AS b FROM kinds a JOIN kinds b ON bit_count((xor(a.fp, b.fp) >> 32)::BIGINT) + bit_count((xor(a.fp, b.fp) & 4294967295)::BIGINT) <= {DISTANCE}),
  reached AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
  classes AS (SELECT a AS fp, min(least) AS component_id FROM reached JOIN kinds ON kinds.fp = reached.b GROUP BY a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM all_of_them JOIN classes USING (fp)
"""
