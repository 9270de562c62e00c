"""From pages to sightings: one row per contact and capture."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import emails, markup, phones, urls
from ..functions import vocabulary as V

CONTACTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "raw")]))
SIGHTINGS = ["kind", "value", "raw", "snapshot_url", "timestamp", "source_url"]


EMAIL, AT, DOT = re.compile(emails.EMAIL), re.compile(emails.AT, re.I), re.compile(emails.DOT, re.I)
SPELLED = re.compile(r"[\[({]\s*@\s*[\])}]|\s@\s|\b(?:at|собака|sobaka)\b", re.I)


def possible(content) -> Column:
    """Whether a page can hold a contact, in whatever way it is written; false only where there is none.

    An address needs an at sign, or a word for it and a dot (or a word for that) in a domain; entities can stand for anything; a number needs six digits, or three and a plus.
    """
    c = F.col(content) if isinstance(content, str) else content
    spelled = c.rlike(r"(?iuU)\b(?:at|собака|sobaka)\b") & c.rlike(r"(?iuU)[.．][A-Za-z]{2}|\b(?:dot|точка|tochka)\b|[\[({]\s*\.")
    return c.rlike("[@＠&]") | spelled | c.rlike(r"(?U)(?:\d\D*+){6}") | (c.rlike("[+＋]") & c.rlike(r"(?U)(?:\d\D*+){3}"))


def extract_emails(text: str) -> list[tuple[str, str]]:
    """value, raw of each address of a normalised text."""
    found: dict[str, str] = {}
    for step, page in enumerate((text, DOT.sub(".", AT.sub("@", text)) if SPELLED.search(text) else "")):
        if "@" not in page:
            continue
        for m in EMAIL.finditer(page):
            value = m[1].lower().rstrip(".,;:")
            local, _, domain = value.partition("@")
            bad = not local or not domain or domain.startswith("www.") or value.endswith(tuple(V.EMAIL_ASSETS)) or any(x in value for x in ("u003e", "u003c", "\\x"))
            if not bad and not (step and local in V.PROSE_WORDS):
                found.setdefault(value, m[1])
    return list(found.items())


def extract_contacts(content: str | None, regions: Iterable[str] = V.PAGE_REGIONS) -> list[dict[str, str]]:
    """Contacts of one page: addresses, then phone numbers."""
    text = markup.normalise(content)
    pairs = [("email", x) for x in extract_emails(text)] + [("phone", x) for x in phones.phones(text, regions)]
    return [{"kind": kind, "value": value, "raw": raw} for kind, (value, raw) in pairs]


#: Pages that are read at a time: the rest of a batch stays in Arrow's memory, and what is found in them is in it again before the next are read.
PAGES = 32


def by_slices(read, rows: int, kind):
    """An Arrow array of what `read` gives for each of so many rows, some rows at a time."""
    return pa.concat_arrays([pa.array([read(i) for i in range(low, min(low + PAGES, rows))], kind) for low in range(0, max(1, rows), PAGES)])


@F.arrow_udf(CONTACTS)
def page_contacts(content: pa.Array, regions: pa.Array) -> pa.Array:
    """Contacts of each page; each is parsed and normalised once for both kinds."""
    def read(i):
        page, own = content[i].as_py(), regions[i].as_py()
        return extract_contacts(page, own if own is not None else V.PAGE_REGIONS) if page else []

    return by_slices(read, len(content), pa.list_(pa.struct([(f.name, pa.string()) for f in CONTACTS.elementType])))


@F.arrow_udf(T.StringType())
def normalised(content: pa.Array) -> pa.Array:
    return by_slices(lambda i: markup.normalise(content[i].as_py()), len(content), pa.string())


@F.pandas_udf(T.StringType())
def human_phone(value: pd.Series) -> pd.Series:
    return value.map(phones.human)


def sightings(pages: DataFrame, regions: Iterable[str] = V.SCAN_REGIONS) -> DataFrame:
    """SIGHTINGS of pages (timestamp, original, content, error); pages with an error hold none."""
    listed = F.array(*map(F.lit, regions)).cast("array<string>")
    good = pages.where("error is null") if "error" in pages.columns else pages
    good = good.where(possible("content"))
    found = good.select("timestamp", "original", F.explode(page_contacts("content", listed)).alias("c"))
    return found.select("c.kind", "c.value", "c.raw", urls.playback("timestamp", "original").alias("snapshot_url"), "timestamp", F.col("original").alias("source_url"))


def nanp_numbers(text) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), F.lit(0))


def errors(pages: DataFrame) -> DataFrame:
    """'<url> @ <timestamp>: <error>' of the pages that have one."""
    return pages.where("error is not null").select(F.concat("original", F.lit(" @ "), "timestamp", F.lit(": "), "error").alias("error"))
