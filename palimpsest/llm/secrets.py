"""Secrets: three base patterns, and strings in sensitive context that are novel to a primed zstandard compressor.

A candidate is a whole run of token characters, of CANDIDATE or more, with a sensitive word within CONTEXT characters before or after
it, that holds a digit and a letter, or letters alone with two capitals in a row and a change of case at every fourth or sooner, on average (so
that names in camel case aren't candidates). The compressor's dictionary is a list of common identifiers and the text around the candidate. What the
candidate adds, in bytes, over compressing nothing is its marginal size: names, words and repeats of what stands nearby
cost little, random keys almost their whole entropy. Candidates of at least NOVELTY marginal bytes per character
are reported as kind `novel`, unless they overlap a base span. NOVELTY is meant for 64 different
characters; of a smaller alphabet, such as upper-case hexadecimal, its share of NOVELTY and TABLE bytes are enough, which is less
for long candidates. Base spans stay as they are. Not reported as novel: keys of digits alone, and of letters of one case alone, which
a compressor can't tell from words that it doesn't know. Every run and every sensitive word is looked at once, so a text takes time in proportion.

Nulls: a null text is empty; a null doc_id is returned as null. Rows that repeat are reported each. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|credential|private|api_?key|access_?key|auth|bearer|signature", re.I | re.A)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER, CAPITALS = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[A-Z]{2}")
CASE_CHANGE = re.compile("[a-z](?=[A-Z])|[A-Z](?=[a-z])")
CANDIDATE = 16
CONTEXT = 64
AROUND = 2048
NOVELTY = 0.7
#: Bytes that the compressor spends on describing a small alphabet, at the least.
TABLE = 8
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret auth authorization bearer session signature credential "
    "username user email login account config settings environment variable public static final class function return import export const "
    "string integer boolean null true false undefined request response header content type application json http https localhost example "
    "test default value name index length object array list dictionary get set create update delete select insert where from table "
    "BEGIN END RSA PRIVATE PUBLIC CERTIFICATE KEY abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
).encode()
BASE = ("assign", "access", "hex")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind; in the order of start, then of kind as listed."""
    lower = text.lower() if not text.isascii() else None
    found = []
    if any(w in (lower or text.lower()) for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))


def marginal_bytes(text: str, start: int, end: int) -> int:
    """Bytes that text[start:end] adds to a compressor primed with identifiers and what is around it."""
    import zstandard

    own = text[start:end]
    around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(squeeze.compress(own.encode())) - len(squeeze.compress(b""))


def least_bytes(own: str) -> float:
    """Marginal bytes from which a candidate is novel, by the size of its alphabet."""
    size = sum(len(kind) for kind in ("0123456789", "+", "/", "_", "=", "-") if not set(kind).isdisjoint(own))
    for six, all_of_them in (("ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("abcdef", "abcdefghijklmnopqrstuvwxyz")):
        used = set(own) & set(all_of_them)
        size += (6 if used <= set(six) else 26) if used else 0
    return min(NOVELTY * len(own), NOVELTY * len(own) * math.log2(size) / 6 + TABLE)


def is_key_like(own: str) -> bool:
    """Whether a run mixes digits and letters, or the two cases of letters, as keys do and words don't."""
    if not LETTER.search(own):
        return False
    return DIGIT.search(own) is not None or CAPITALS.search(own) is not None and 4 * sum(1 for _ in CASE_CHANGE.finditer(own)) >= len(own) - 1


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    begins, ends = zip(*words, strict=True)
    first, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    found = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        before, after = bisect_right(ends, s), bisect_left(begins, e)
        if not (before and s - ends[before - 1] <= CONTEXT or after < len(begins) and begins[after] - e <= CONTEXT) or not is_key_like(m[0]):
            continue
        under = bisect_left(first, e)
        if under and reach[under - 1] > s:
            continue
        if marginal_bytes(text, s, e) >= least_bytes(m[0]):
            found.append((s, e, "novel"))
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text: start, end (code points, end exclusive), kind."""
    base = base_spans(text)
    return sorted([*base, *novel_spans(text, base)], key=lambda s: (s[0], (*BASE, "novel").index(s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of start, end, kind) of every row of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for part in common.slices(batch):
                found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t.decode())] for t in common.texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def listed(found) -> "F.Column":  # noqa: F821
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets' spans, base ones counted and hashed."""
    found = scan(common.table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("novel"))
